"""Sum-of-squares online packing of tokenised documents into windows of a fixed length.

A packer keeps a level array: N[h] counts its open windows at fill level h, a level being a
``LEVELS``-th of a window, rounded up. A document's tail (what remains after whole windows are cut off) is
placed, or cut once to close a window with its first part and open a fresh one with the rest, in the way
that makes the sum of N[h]**2 smallest, a cut counting as ``CUT`` more. A window that reaches the full length
closes. A level with over CUT / 2 + 1 windows is never chosen while another way is left, so at
most (LEVELS + 1) * (CUT / 2 + 2) windows are open, whatever the documents.

Windows still open at the end of a partition are drained: their pieces, in order, are cut into full
windows anew, and what is left over into windows whose lengths are powers of two, which need no
padding. Each partition packs alone, so there is no shuffle and memory is bounded by the open windows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

WINDOW, END_ID, LEVELS, CUT = 4096, 2, 16, 8
_CACHE = 400_000
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _byte_marks() -> list[str]:
    """The printable stand-in of every byte value in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"[{_LETTERS}0-9!-/:-@\[-`{{-~]+")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_MARKS = _byte_marks()
_STAND_IN = {i: "".join(_MARKS[b] for b in chr(i).encode()) for i in range(256)}


class WordCache:
    """Ids of a text as little-endian uint32 bytes, remembered by blank-separated chunk.

    The tokenizer drops white space and no rule of it looks across a blank or a line feed, so a
    text's ids are those of its chunks in order. Chunks of Latin letters, digits and ASCII signs
    are lower-cased and split here and go to the tokenizer's model part by part; any other chunk
    goes through the whole tokenizer. The memory is emptied when it is full.
    """

    def __init__(self, path: str, limit: int = _CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.known, self.parts = {"": b""}, {}

    def _part(self, part: str) -> bytes:
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(part.translate(_STAND_IN)))
        self.parts[part] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if _SIMPLE.fullmatch(chunk) and "<|" not in chunk:
            known = self.parts
            return b"".join([known.get(p) or self._part(p) for p in _PARTS.findall(chunk.lower())])
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) + len(self.parts) > self.limit:
            self.known, self.parts = {"": b""}, {}
        known, out = self.known, []
        for text in texts:
            chunks = text.replace("\n", " ").split(" ")
            try:
                out.append(b"".join([known[c] for c in chunks]))
            except KeyError:
                for c in chunks:
                    if c not in known:
                        known[c] = self._chunk(c)
                out.append(b"".join([known[c] for c in chunks]))
        return out


class Packer:
    """One partition's online packer. Pieces come out when their window closes."""

    def __init__(self, first_sequence: int, window: int = WINDOW, levels: int = LEVELS, cut: int = CUT) -> None:
        self.window, self.unit, self.cut, self.next_sequence = window, max(1, window // levels), cut, first_sequence
        self.levels = np.zeros(-(-window // self.unit) + 1, np.int64)
        #: The fill of the window that was last put on each level; level 0 is the fresh window.
        self.fills = np.full(len(self.levels), -1, np.int64)
        self.fills[0] = 0
        self.open: dict[int, list[tuple[int, list[tuple]]]] = {}
        self.done: list[tuple] = []
        self.drained = 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, ids, total, self.next_sequence, offset))
            offset += n
        self.next_sequence += 1

    def choose(self, size: int) -> int:
        """The level to fill from (0: a fresh window) with the least sum of squares after it; the fuller one of equals.

        Where the size is over the room left there, the document is to be cut.
        """
        full = self.fills + size
        whole = full <= self.window
        rest = np.where(whole, full, full - self.window)
        to = -(-rest // self.unit)
        change = np.where(rest == self.window, 0, 2 * self.levels[to] + 1) - np.where(self.fills > 0, 2 * self.levels - 1, 0)
        change += np.where((to == np.arange(len(to))) & (self.fills > 0) & (rest < self.window), -2, 0)  # that level's own window is gone by then
        change = 2 * (change + np.where(whole, 0, self.cut)) + ~whole
        change[self.fills < 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def _put(self, fill: int, pieces: list[tuple]) -> None:
        if fill == self.window:
            self._close(pieces)
            return
        level = -(-fill // self.unit)
        self.open.setdefault(level, []).append((fill, pieces))
        self.levels[level] += 1
        self.fills[level] = fill

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        whole = total - total % w
        for at in range(0, whole, w):
            self._close([(doc_id, at, ids[4 * at:4 * (at + w)], total)])
        if whole == total:
            return
        size = total - whole
        level = self.choose(size)
        fill, pieces = 0, []
        if level:
            left = self.open[level]
            fill, pieces = left.pop()
            self.levels[level] -= 1
            self.fills[level] = left[-1][0] if left else -1
        first = min(size, w - fill)
        pieces.append((doc_id, whole, ids[4 * whole:4 * (whole + first)], total))
        self._put(fill + first, pieces)
        if first < size:
            self._put(size - first, [(doc_id, whole + first, ids[4 * (whole + first):], total)])

    def drain(self) -> None:
        """Cut what the open windows hold into full windows and a rest in powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for _, held in self.open[level] for p in held]
        left = sum(len(p[2]) // 4 for p in pieces)
        self.drained += left
        self.open, self.levels[:], self.fills[1:] = {}, 0, -1
        current, room = [], 0
        for doc_id, start, ids, total in pieces:
            n, at = len(ids) // 4, 0
            while at < n:
                if not room:
                    room = min(self.window, 1 << (left.bit_length() - 1))
                    left -= room
                take = min(room, n - at)
                current.append((doc_id, start + at, ids[4 * at:4 * (at + take)], total))
                at, room = at + take, room - take
                if not room:
                    self._close(current)
                    current = []

    def taken(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` holds the piece as little-endian uint32. A null or empty text is the end id alone.
    Repeated rows are packed each for itself; a null doc_id stays null. An empty table gives no
    piece. ``window`` must be a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = WordCache(tokenizer_path), np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        for b in batches:
            doc_ids = b["doc_id"].to_pylist()
            for at in range(0, len(doc_ids), 256):
                texts = [t or "" for t in b["text"].slice(at, 256).to_pylist()]
                for doc_id, ids in zip(doc_ids[at:at + 256], cache.ids(texts), strict=True):
                    packer.add(doc_id, ids + end)
                if packer.done:
                    yield _batch(packer.taken())
        packer.drain()
        if packer.done:
            yield _batch(packer.taken())
        del cache, packer
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)
