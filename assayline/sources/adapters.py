"""Source adapters: what reads which files into positioned items.

A decoder turns a file's bytes into pages of items (text, x, y, w, h, page-normalised). Decoders run on the executors
over Spark's ``binaryFile`` scan; one for PDF needs a PDF library, which is plugged in with ``register``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Page = list[dict]
SCHEMA = "source_id string, page int, item int, text string, x double, y double, w double, h double, failure string"


@dataclass(frozen=True)
class Adapter:
    """``supports`` looks at a file's name and first bytes; ``decode`` gives its pages or raises."""

    id: str
    tier: int
    supports: Callable[[str, bytes], bool]
    decode: Callable[[bytes], list[Page]]


def _scan_pages(content: bytes) -> list[Page]:
    return json.loads(content)["fragmented"]["pages"]


ADAPTERS: list[Adapter] = [Adapter("positioned-text", 1, lambda name, head: name.endswith(".json") and head[:1] == b"{", _scan_pages)]


def register(adapter: Adapter) -> None:
    """Add an adapter; of those that support a file the one of the lowest tier reads it."""
    ADAPTERS.append(adapter)
    ADAPTERS.sort(key=lambda a: a.tier)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Items of all files under ``path``; a file that no adapter supports or that does not decode is one row with its failure.

    Pages stay in order and items without text are dropped.
    """
    adapters = list(ADAPTERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for pdf in batches:
            for name, content in zip(pdf["source_id"], pdf["content"], strict=True):
                rows, failure = [], None
                found = next((a for a in adapters if a.supports(name, content[:16])), None)
                if found is None:
                    failure = "unsupported-type"
                else:
                    try:
                        pages = found.decode(content)
                        rows = [(name, p, n, i["text"], i["x"], i["y"], i["w"], i["h"], None) for p, page in enumerate(pages, 1) for n, i in enumerate(page, 1) if i["text"]]
                    except Exception:  # noqa: BLE001 - whatever a decoder raises is that file's failure
                        failure = "decode-failed"
                yield pd.DataFrame(rows if failure is None else [(name, None, None, None, None, None, None, None, failure)], columns=names).astype({"page": "Int32", "item": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_id"), "content").mapInPandas(run, SCHEMA)
