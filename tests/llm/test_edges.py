"""Ties and repeats that the other tests do not reach."""

import numpy as np
from pyspark.sql import functions as F

from assayline.llm import packing, vafile


def test_many_equal_vectors_go_to_the_smallest_ids(spark):
    rows = [(i, [0.5, 0.25]) for i in range(400)]
    v = vafile.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = vafile.top_k(v, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 8 * 5
    for q in range(0, 400, 50):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for i in range(7) if i != q][:5]


def test_packer_with_one_very_long_document():
    ids = np.arange(10**6, dtype="<u4").tobytes()
    p = packing.Packer(0)
    p.add(1, ids)
    p.drain()
    rows = p.taken()
    assert b"".join(r[3] for r in sorted(rows, key=lambda r: r[1])) == ids
