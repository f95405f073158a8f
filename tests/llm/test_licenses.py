import numpy as np

from assayline.llm import licenses

SCHEMA = "doc_id long, text string"


def scores(text):
    """Probabilities and coverages of one paragraph, in numpy."""
    m = licenses.model()
    held = licenses.features(text)
    z = np.array(m["offsets"]) + sum((np.array(m["weights"][g]) for g in held if g in m["weights"]), np.zeros(len(m["classes"])))
    p = np.exp(z - z.max())
    return p / p.sum(), [(f, t, len(held & set(gs)) / len(gs)) for f, _, t, gs in m["notices"]]


def test_every_notice_is_recognised_and_confirmed(spark):
    rows, want = [], {}
    for family, notices in licenses.NOTICES.items():
        for t in notices:
            want[len(rows)] = family
            rows.append((len(rows), f"warm rain fell\n  {t.upper() if len(rows) % 2 else t}\nbefore noon"))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: (r.family, r.confirmed, r.paragraph, r.lines) for i, r in got.items()} == {i: (f, True, 1, 1) for i, f in want.items()}


def test_wrapped_notices_are_seen_whole(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    rows = [(1, f"Rain.\n{bsd}\n\nSnow."), (2, f"{mit}\n\n{bsd}"), (3, "Released under MIT"), (4, "GPL v3"), (5, "under Apache 2.0\r\n"), (6, "CC BY 4.0")]
    got = sorted((r.doc_id, r.paragraph, r.lines, r.family, r.confirmed) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got[:3] == [(1, 1, 3, "BSD", True), (2, 0, 2, "MIT", True), (2, 3, 3, "BSD", True)]
    assert [(g[0], g[3]) for g in got[3:]] == [(3, "MIT"), (4, "GPL-3.0"), (5, "Apache-2.0"), (6, "CC-BY")]


def test_scores_and_coverage_equal_numpy(spark):
    texts = [*licenses.UNTRAINED, *licenses.OTHER, "Released under the MIT License, version 3 of the work by the author", "the license of this work is the GNU General Public License", "all rights reserved by the publisher of the software"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    m, seen = licenses.model(), 0
    empty = licenses._softmax(np.array([m["offsets"]]))[0, -1]
    for i, t in enumerate(texts):
        p, cover = scores(t)
        best = int(p.argmax())
        sure = best < len(p) - 1 and p[best] >= m["threshold"]
        if not licenses.features(t) & m["weights"].keys() or (not sure and p[-1] >= empty):
            assert i not in got or abs(p[-1] - empty) < 1e-4, t
            continue
        seen += 1
        r = got[i]
        assert r.family == (m["classes"][best] if sure else "unknown") and np.isclose(r.score, p[best], atol=1e-4), t
        near = max((c for f, _, c in cover if f == r.family), default=0.0)
        assert np.isclose(r.coverage, near) and r.confirmed == (sure and near >= licenses.CONFIRM)
    assert seen >= 5


def test_a_line_without_a_content_word_has_no_feature():
    import re

    for t in [*licenses.OTHER, *licenses.UNTRAINED, "nothing here", "x.mit", "mit.", "-mit-", "submit a form", "a GPLv3, b"]:
        assert bool(re.search(licenses.gate(), t)) == bool(licenses.features(t)), t


def test_sentences_never_trained_on_stay_unknown(spark):
    rows = list(enumerate([*licenses.UNTRAINED, "my driving license was lost at the sea", "she gave permission for the trip", "copyright is a word of nine letters and more", "der mann kam mit der frau"]))
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.family == "unknown" and not r.confirmed for r in got)


def test_grams_agree_with_the_column_form(spark):
    from pyspark.sql import functions as F

    texts = ["Licensed under CC BY-NC 4.0.", "", "...", "a", "SPDX-License-Identifier: GPL-3.0-only (x)", "v. 2.0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licenses._gram_column(F.col("t")).alias("g"))
    for r in df.collect():
        assert sorted(r.g) == sorted(set(licenses.grams(r.t)))


def test_odd_rows_and_repeats(odd_docs, no_docs, spark):
    assert licenses.scan(odd_docs).where("family <> 'unknown'").count() == 0 and licenses.scan(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License.\n\n" * 2)] * 2, SCHEMA)
    assert licenses.scan(twice).count() == 4
