"""Progress of a running batch or stream, and ending it early."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Collects (query id, batch, rows) of every trigger; what was finished before a stop stays."""

    def __init__(self) -> None:
        self.started: list[str] = []
        self.events: list[tuple[str, int, int]] = []
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.started.append(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.events.append((str(event.progress.id), event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append(str(event.id))


@contextmanager
def watched(spark: SparkSession):
    """A listener for the time of the block."""
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def each_source(spark: SparkSession, sources: list[tuple[str, DataFrame]], write, cancelled=lambda: False):
    """Write source after source, yielding (name, 0, 0) before and (name, rows, rows) after each; between two of them a batch can
    be cancelled, and what was written stays."""
    for name, df in sources:
        if cancelled():
            yield "cancelled", 0, 0
            return
        yield name, 0, 0
        spark.sparkContext.setJobGroup(f"source-{name}", name, interruptOnCancel=True)
        n = write(name, df)
        yield name, n, n
