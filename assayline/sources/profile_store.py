"""A stored profile table: versions in a folder, written whole and swapped by one marker file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile


class ProfileStore:
    """Measurements of one store under ``path``, in versions; the highest version whose write finished is the store.

    A write that fails leaves the version before it in place, so readers never see half a table. Only Hadoop's file
    systems are used, so any store that Spark knows will do.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, finished: bool = True) -> list[int]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        found = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]
        return sorted(v for v in found if not finished or self._fs.exists(self._path(f"{self.path}/v{v}/_SUCCESS")))

    @staticmethod
    def check(measurements: DataFrame) -> None:
        """Raise if a measurement breaks a rule: what is invalid is neither written nor read."""
        bad = profile.measurement_violations(measurements).select("report_id", "marker_key", "rule").first()
        if bad:
            raise ValueError(f"reports[{bad[0]}].measurements[{bad[1]}]: {bad[2]}")

    def load(self) -> DataFrame | None:
        """The stored measurements; None if nothing was stored. Invalid data raise instead of counting as nothing."""
        versions = self._versions()
        if not versions:
            return None
        df = self.spark.read.parquet(f"{self.path}/v{versions[-1]}")
        self.check(df)
        return df

    def replace(self, measurements: DataFrame) -> None:
        """Make this the store: written beside the old version, which goes only when the new one is whole."""
        self.check(measurements)
        old = self._versions(finished=False)
        new = old[-1] + 1 if old else 1
        measurements.write.parquet(f"{self.path}/v{new}")
        for v in old:
            self._fs.delete(self._path(f"{self.path}/v{v}"), True)

    def repair(self) -> int:
        """Drop versions whose write never finished; how many there were."""
        broken = sorted(set(self._versions(finished=False)) - set(self._versions()))
        for v in broken:
            self._fs.delete(self._path(f"{self.path}/v{v}"), True)
        return len(broken)

    def drop(self, caches: str | None = None) -> None:
        """Delete the store, and every sibling folder whose name starts with ``caches``."""
        self._fs.delete(self._path(self.path), True)
        parent = self._path(self.path).getParent()
        if caches and self._fs.exists(parent):
            for s in self._fs.listStatus(parent):
                if s.getPath().getName().startswith(caches):
                    self._fs.delete(s.getPath(), True)


def preview(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """How many arriving reports would be added, are held already or conflict. Nothing is written: the plan is lazy."""
    plan = profile.merge_plan(stored, arriving, "report_id")
    return plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
