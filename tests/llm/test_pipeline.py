import os
import subprocess
import sys

import pytest

import corpus_pipeline
from assayline.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, odd_docs, tmp_path):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs.withColumn("text", F.when(F.col("doc_id") == 3, F.concat("text", F.lit(" token = abcdef12345"))).otherwise(F.col("text")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), odd_docs.schema)
        assert docs.columns == odd_docs.columns, name
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert 4 not in rows and 5 not in rows and 6 not in rows and 2 not in rows and 1 in rows and 7 in rows
    assert "abcdef" not in " ".join(rows.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(rows)


def test_run_on_a_small_table(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 100


@pytest.mark.parametrize("name", [f"op{i}" for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)])
def test_every_query_covers_its_table(spark, name):
    name = next(n for n in queries.QUERIES if n.startswith(f"{name}_"))
    got = queries.QUERIES[name](spark, SF)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    everything = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert ids <= everything if name.startswith("op8") else ids == everything


def test_the_rest_stands_without_these_folders(tmp_path):
    """What remains when this folder and the pipeline are deleted still imports and passes its tests."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "copy"
    import shutil

    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": os.pathsep.join([str(copy), os.environ.get("PYTHONPATH", "")])}, capture_output=True).returncode == 0
    inherited = os.pathsep.join([str(copy), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))])
    # every test of the rest is collected; of the queries' own, which the driver runs anyway, a few are run again here
    chosen = "not test_query_equals_its_sql or confirm_gate or series_build or greedy or parse_layouts"
    run = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-x", "-q", "-p", "no:cacheprovider", "-k", chosen], cwd=copy, env={**os.environ, "PYTHONPATH": inherited}, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]
