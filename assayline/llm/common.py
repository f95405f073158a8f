"""Helpers shared by the training-data operators: table access, splits, shared files."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where a session on one machine names none (tests) a local one is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="assayline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later step reads, and let Spark drop the shuffles behind it."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        gc.collect()
        jvm.System.gc()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Give memory that a partition no longer needs back to the machine: workers live on beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def spread_join(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``left`` joined to ``right``, a materialised table with one row of a key and in ``times`` the key's rows in ``left``.

    Keys with more than one in ``share`` of those rows, so fewer than ``share`` keys, are broadcast; only the others
    are shuffled, so no key gathers in one task.
    """
    total = right.agg(F.sum("times")).first()[0] or 0
    often = F.col("times") * share > total
    hot = right.where(often)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(~often), key)
    return left.join(F.broadcast(hot), key).unionByName(rest)
