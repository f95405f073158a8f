"""Offset-preserving SentencePiece encoding and decoding.

``Normalizer`` walks a text by the longest prefix that the model's compiled character map
rewrites, and keeps for every normalised byte the original byte it came from. Pieces are then
projected back to spans of original bytes. Segmentation runs on the normalised text, cut before
each word mark that follows another character: where no piece of the vocabulary crosses such a
cut, segments are independent, so a bounded memory of segments serves repeated words.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_MARK = MARK.encode()
_CACHE = 600_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field number, wire type, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, kind, data[at:at + size]
            at += size


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


class Normalizer:
    """The model's normaliser specification, applied with source alignment."""

    def __init__(self, spec: bytes) -> None:
        got = {n: v for n, _, v in _fields(spec)}
        self.dummy_prefix, self.squeeze, self.escape = (bool(got.get(n, 1)) for n in (3, 4, 5))
        blob = got.get(2, b"")
        self.units = self.texts = None
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units, self.texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size:]

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(length, place of the replacement) of the longest mapped prefix; (0, -1): none."""
        unit, node, found = self.units, 0, (0, -1)
        node ^= _offset(unit[0])
        for i in range(at, len(data)):
            node ^= data[i]
            u = unit[node]
            if u & 0x800000FF != data[i]:
                break
            node ^= _offset(u)
            if u >> 8 & 1:
                found = (i + 1 - at, unit[node] & 0x7FFFFFFF)
        return found

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The character map alone: (bytes, source of each byte)."""
        if self.units is None:
            return data, np.arange(len(data))
        out, source, at = bytearray(), [], 0
        while at < len(data):
            n, place = self._longest(data, at)
            if n:
                new = self.texts[place:self.texts.index(b"\0", place)]
            else:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                new = data[at:at + n]
            out += new
            source += [at] * len(new)
            at += n
        return bytes(out), np.array(source, dtype=np.int64)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised UTF-8, for each of its bytes and its end the original byte offset)."""
        new, source = self._mapped(data)
        keep = np.frombuffer(new, np.uint8)
        blank = keep == 32
        if self.squeeze and len(keep):
            inner = ~blank | (np.r_[False, ~blank[:-1]] & (np.cumsum(~blank) < (~blank).sum()))
            keep, source = keep[inner], source[inner]
            blank = keep == 32
        if not len(keep):
            return b"", np.array([len(data)])
        text = keep.tobytes()
        if self.escape:
            source, text = np.repeat(source, np.where(blank, len(_MARK), 1)), text.replace(b" ", _MARK)
        if self.dummy_prefix:
            head = _MARK if self.escape else b" "
            source, text = np.r_[np.full(len(head), source[0]), source], head + text
        while self.squeeze and text.endswith(_MARK if self.escape else b" "):  # marks of the text itself count as blanks here
            text = text[:-len(_MARK if self.escape else b" ")]
        source = source[:len(text)]
        return text, np.r_[source, len(data)]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, limit: int = _CACHE) -> None:
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = f.read()
        pieces, rest, spec = [], bytearray(), b""
        for n, kind, value in _fields(model):
            if n == 1:
                got = {m: v for m, _, v in _fields(value)}
                pieces.append((got.get(1, b""), got.get(3, _NORMAL)))
            if n == 3:
                spec = value
            elif kind == 2:
                rest += _varint(n << 3 | 2) + _varint(len(value)) + value
        self.normalizer = Normalizer(spec)
        self.kinds = [k for _, k in pieces]
        self.surface = [bytes([int(p[3:5], 16)]) if k == _BYTE else p for p, k in pieces]
        self.width = np.array([len(s) for s in self.surface])
        self.silent = np.isin(self.kinds, (_UNKNOWN, _CONTROL))
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == _UNKNOWN), 0)
        crossing = any(re.search(f"[^{MARK}]{MARK}", p.decode("utf-8", "replace")) for p, k in pieces if k not in (_BYTE, _CONTROL))
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not crossing else re.compile("(?s).+")
        plain = b"\x0a\x08identity" + b"\x18\x00\x20\x00\x28\x00"
        self.segmenter = SentencePieceProcessor(model_proto=bytes(rest) + _varint(3 << 3 | 2) + _varint(len(plain)) + plain)
        self.limit, self.known = limit, {}

    def _segments(self, texts: list[bytes]) -> list[list[str]]:
        if len(self.known) > self.limit:
            self.known = {}
        split = [self.cut.findall(t.decode()) for t in texts]
        new = list({c for s in split for c in s if c not in self.known})
        for c, ids in zip(new, self.segmenter.encode(new, num_threads=1) if new else [], strict=True):
            self.known[c] = array("i", ids).tobytes()
        return split

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each UTF-8 text: ids, and each piece's begin and end in original bytes."""
        normal = [self.normalizer(t) for t in texts]
        for parts, (text, source) in zip(self._segments([t for t, _ in normal]), normal, strict=True):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.int32)
            width = self.width[ids]
            if self.unknown in ids:
                width = self._unknown_width(ids, width, text)
            ends = np.cumsum(width)
            yield ids, source[ends - width], source[ends]

    def _unknown_width(self, ids: np.ndarray, width: np.ndarray, text: bytes) -> np.ndarray:
        """A model without byte pieces: an unknown piece reaches to where the next known one starts."""
        width, at = width.copy(), 0
        for i, x in enumerate(ids.tolist()):
            if x == self.unknown:
                after = next((self.surface[y] for y in ids[i + 1:i + 2].tolist() if y != self.unknown), None)
                end = text.index(after, at + 1) if after else len(text)
                width[i] = end - at
            at += int(width[i])
        return width

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of the ids, as the library decodes them."""
        kinds, surface = self.kinds, self.surface
        silent = self.silent[np.asarray(ids, np.int64)]
        ids = np.asarray(ids).tolist()
        for i, x in enumerate(ids):
            if kinds[x] != _CONTROL:
                break
        else:
            return ""
        if kinds[ids[i]] == _NORMAL and self.normalizer.dummy_prefix and surface[ids[i]].startswith(_MARK):
            first, rest = surface[ids[i]][len(_MARK):], ids[i + 1:]
        else:
            first, rest = b"", ids[i:]
        if not silent[len(ids) - len(rest):].any():
            return _lenient(first + b"".join(map(surface.__getitem__, rest))).replace(MARK, " ")
        out, run = [], [first]
        for x in rest:
            if kinds[x] in (_UNKNOWN, _CONTROL):
                out += [_lenient(b"".join(run)), " ⁇ " if kinds[x] == _UNKNOWN else ""]
                run = []
            else:
                run.append(surface[x])
        return "".join([*out, _lenient(b"".join(run))]).replace(MARK, " ")


def _lenient(data: bytes) -> str:
    """UTF-8 with one replacement character for every byte that is part of no character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out = []
        while data:
            try:
                return "".join([*out, data.decode()])
            except UnicodeDecodeError as e:
                out.append(data[:e.start].decode() + "�")
                data = data[e.start + 1:]
        return "".join(out)


@lru_cache(1)
def _codec(path: str) -> Codec:
    """A worker's codec, kept with its memory of segments from task to task."""
    return Codec(path)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, begins, ends): piece ids and their spans in bytes of the original text.

    No begin or end ids. A null or empty text has no pieces. One row per input row, repeated rows
    included; a null doc_id stays null. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or b"" for t in part["text"].cast(pa.binary()).to_pylist()]
                cols = list(zip(*codec.encode(texts), strict=True))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *map(_lists, map(list, cols))], ["doc_id", "ids", "begins", "ends"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The kept columns and ``decoded``, the text of ``ids``; null ids decode to the empty text."""
    source = encoded.select(*keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                flat, ends = np.asarray(part["ids"].flatten()), np.cumsum([0, *part["ids"].value_lengths().fill_null(0).to_pylist()])
                texts = [codec.decode(flat[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return source.mapInArrow(run, ", ".join([*fields, "decoded string"]))
