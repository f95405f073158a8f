"""Secret scanning with a recursive decoding worklist.

A text is scanned as it stands; then URL escapes, Unicode escapes, base64 and compressed layers
are unwrapped, each new layer is scanned and put on the worklist again, until no new layer
appears. Layers seen before are not entered twice, so cycles end. Every character of a layer
knows the span of the original text it came from, and findings are reported as such spans.
Compressed data are looked for in every layer, at any place, and all their members are read. Bytes
that are no text are scanned like text.

What unfolds to more than ``PIECE`` bytes is never held: it flows through windows (``Flow``), and whatever
begins in a window and goes on beyond it, compressed data, base64 over any number of lines or escapes, is
decoded on by a reader of its own that gets the following bytes too. So no cut falls inside nested data, and
memory depends on the windows and the depth of the nesting, not on the size. Time does depend on it: every
byte that a text unfolds to is read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: The kinds in their order and their patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_LITERAL = re.compile(r"""\\(?:x[0-9A-Fa-f]{2}|[nrtabfv0\\'"])""")
_SIMPLE = dict(zip("nrtabfv0\\'\"", "\n\r\t\a\b\f\v\0\\'\"", strict=True))
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, all but the last of 40 signs or more.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
#: How compressed data begin (gzip, zlib, bzip2, xz).
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17\x72\x45\x38\x50\x90)|\xfd7zXZ\x00")
_MAGIC_TEXT, _BYTES = re.compile(_MAGIC.pattern.decode("latin-1")), re.compile(r"[\x00-\xff]+")
#: Layers of more bytes than this flow through windows of this size, which overlap by so many bytes: more than any pattern needs to match.
PIECE, OVERLAP, CYCLE = 1 << 22, 1 << 16, 16
#: Compressed bytes fed and unfolded at a time.
STEP = 1 << 10
#: The same runs of signs in bytes; what ends one; escapes that a window holds.
_SIGNS = rb"A-Za-z0-9+/_\-"
_RUNS = [re.compile(p.pattern.encode()) for p in (_BASE64, _WRAPPED)]
_BREAK = re.compile(rb"[^" + _SIGNS + rb"=\r\n \t]|(?<![" + _SIGNS + rb"])[" + _SIGNS + rb"]{0,39}=*[\r\n \t]")


def scan_plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of one layer's findings, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text; begins and ends say where in the original each character came from.

    A layer made of bytes also has these, with the spans of each.
    """

    def __init__(self, text: str, begins: np.ndarray, ends: np.ndarray, path: tuple[str, ...], data: tuple[bytes, np.ndarray, np.ndarray] | None = None) -> None:
        self.text, self.begins, self.ends, self.path, self.data = text, begins, ends, path, data

    @classmethod
    def of_bytes(cls, data: bytes, begins: np.ndarray, ends: np.ndarray, path: tuple[str, ...]) -> Layer:
        """Bytes as UTF-8; each that belongs to no character becomes a character of its own."""
        text, whole = data.decode("utf-8", "surrogateescape"), (data, begins, ends)
        if len(text) < len(data):
            at = np.cumsum([0, *(len(c.encode("utf-8", "surrogateescape")) for c in text)])
            begins, ends = begins[at[:-1]], ends[at[1:] - 1]
        return cls(text if text.isascii() else re.sub("[\udc80-\udcff]", "\ufffd", text), begins, ends, path, whole)


class Unfold:
    """Compressed data, member by member, as they come. Damaged data give what could be read before the damage.

    Data are fed in steps counted from each member's beginning, so what damaged data give does not hang on how they came.
    """

    def __init__(self) -> None:
        self.buffer, self.at, self.unzip, self.done, self.used = b"", 0, None, False, 0

    def outputs(self, data: bytes, last: bool = False) -> Iterator[bytes]:
        """What can be unfolded now; ``used`` counts the bytes read so far."""
        self.buffer, self.at = self.buffer[self.at:] + data, 0
        while not self.done:
            left = len(self.buffer) - self.at
            if self.unzip is None:
                if left < 16 and not last:
                    return
                self.done = not _MAGIC.match(self.buffer, self.at)
                if self.done:
                    return
                self.unzip = {0x1F: lambda: zlib.decompressobj(31), 0x78: zlib.decompressobj, 0x42: bz2.BZ2Decompressor, 0xFD: lzma.LZMADecompressor}[self.buffer[self.at]]()
            fed = self.buffer[self.at:self.at + STEP]
            if not fed or (len(fed) < STEP and not last):
                self.done = last
                return
            self.at += len(fed)
            self.used += len(fed)
            while True:
                try:
                    out = self.unzip.decompress(fed, STEP)
                except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                    self.done = True
                    return
                fed = getattr(self.unzip, "unconsumed_tail", b"")
                if self.unzip.eof:
                    self.at -= len(self.unzip.unused_data)
                    self.used -= len(self.unzip.unused_data)
                    self.unzip = None
                if out:
                    yield out
                if self.unzip is None or not (fed or out):
                    break


def _stream(data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """What compressed data that begin here unfold to, and up to where they were read."""
    unfold = Unfold()
    for low in range(at, len(data), OVERLAP):
        for out in unfold.outputs(data[low:low + OVERLAP], low + OVERLAP >= len(data)):
            yield out, at + unfold.used
        if unfold.done:
            return


class Large:
    """Compressed data that unfold to more than a window holds: the compressed run, and where it stands."""

    def __init__(self, run: bytes, at: int, begin: int, end: int, path: tuple[str, ...]) -> None:
        self.run, self.at, self.begin, self.end, self.path = run, at, begin, end, path

    def report(self, found: dict) -> None:
        flow = Flow(self.begin, self.end, self.path, found)
        for out, _ in _stream(self.run, self.at):
            flow.feed(out)
        flow.close()


def _flat(data: bytes, begin: int, end: int, path: tuple[str, ...]) -> Layer:
    """Bytes that all come from one span; its arrays take no memory."""
    text = data.decode("utf-8", "surrogateescape")
    text = text if text.isascii() else re.sub("[\udc80-\udcff]", "\ufffd", text)
    ends = lambda n: (np.broadcast_to(np.int64(begin), n), np.broadcast_to(np.int64(end), n))
    return Layer(text, *ends(len(text)), path, (data, *ends(len(data))))


def _inflated(layer: Layer) -> Iterator[Layer | Large]:
    """The layers compressed in a layer, wherever they begin."""
    data, begins, ends = layer.data or (b"", layer.begins, layer.ends)
    runs = [(0, data)] if layer.data else [(m.start(), m[0].encode("latin-1")) for m in _BYTES.finditer(layer.text)] if _MAGIC_TEXT.search(layer.text) else []
    for low, run in runs:
        for m in _MAGIC.finditer(run):
            size, used, held = 0, m.start(), []
            for out, used in _stream(run, m.start()):
                size += len(out)
                held = [*held, out] if size <= PIECE else []
            if not size:
                continue
            begin, end, path = int(begins[low + m.start()]), int(ends[low + used - 1]), (*layer.path, "compressed")
            yield _flat(b"".join(held), begin, end, path) if size <= PIECE else Large(run, m.start(), begin, end, path)


class Inflate:
    """Compressed data that come bit by bit; what they unfold to goes to ``sink`` until they end or are damaged."""

    def __init__(self, sink: Gather) -> None:
        self.sink, self.unfold, self.done = sink, Unfold(), False

    def feed(self, data: bytes, last: bool = False) -> None:
        for out in self.unfold.outputs(data, last):
            self.sink.feed(out)
        if (self.unfold.done or last) and not self.done:
            self.done = True
            self.sink.close()

    def close(self) -> None:
        if not self.done:
            self.feed(b"", last=True)


class Signs:
    """A run of base64 signs that comes bit by bit, over one line or several; it ends at the first byte that cannot belong to it."""

    def __init__(self, sink: Gather) -> None:
        self.sink, self.held, self.line, self.done = sink, b"", 0, False

    def feed(self, data: bytes) -> None:
        for m in re.finditer(rb"([" + _SIGNS + rb"]+)|(\r?\n[ \t]*)|(.)", data, re.DOTALL):
            if m[1]:
                self.held += m[1]
                self.line += len(m[1])
            elif m[2] and self.line >= 40:
                self.line = 0
            elif m[0] not in (b"\r", b" ", b"\t") or self.line:
                self.close()
                return
        whole = len(self.held) // 4 * 4
        self._decode(self.held[:whole])
        self.held = self.held[whole:]

    def _decode(self, signs: bytes) -> None:
        self.sink.feed(base64.b64decode(signs.replace(b"-", b"+").replace(b"_", b"/")))

    def close(self) -> None:
        if not self.done:
            self.done = True
            if len(self.held) % 4 != 1:
                self._decode(self.held + b"=" * (-len(self.held) % 4))
            self.sink.close()


class Rewrite:
    """A layer that comes bit by bit with its escapes decoded; what may be the beginning of one waits for the rest."""

    def __init__(self, sink: Gather, pattern: re.Pattern, part, wait: re.Pattern) -> None:
        self.sink, self.pattern, self.part, self.wait, self.held, self.done = sink, pattern, part, wait, b"", False

    def feed(self, data: bytes, last: bool = False) -> None:
        data = self.held + data
        m = None if last else self.wait.search(data, max(0, len(data) - 64))
        cut = m.start() if m else len(data)
        self.held = data[cut:]
        self.sink.feed(self.pattern.sub(lambda e: self.part(e[0]), data[:cut]))

    def close(self) -> None:
        self.feed(b"", last=True)
        self.done = True
        self.sink.close()


_REWRITES = {
    "url": (re.compile(_URL.pattern.encode()), lambda e: bytes.fromhex(e.replace(b"%", b"").decode()), re.compile(rb"%[0-9A-Fa-f]?\Z")),
    "unicode": (re.compile(_UNICODE.pattern.encode()), lambda e: _unicode_part(e.decode())[0].encode("utf-8", "replace"), re.compile(rb"(?:\\[uUx{}0-9A-Fa-f]*|(?:\\u[dD][89abAB][0-9A-Fa-f]{2})(?:\\u?[0-9A-Fa-f]*)?|&#?[xX]?[0-9A-Fa-f]*)\Z")),
    "literal": (re.compile(_LITERAL.pattern.encode()), lambda e: _literal_part(e.decode())[0].encode("latin-1"), re.compile(rb"\\(?:x[0-9A-Fa-f]?)?\Z"))}


#: What a window must hold before its escapes are looked for.
_HINTS = {"url": (b"%",), "unicode": (b"\\u", b"\\U", b"\\x", b"&#"), "literal": (b"\\x",)}


class Gather:
    """What a reader decodes: a layer of its own if it stays small, else a flow."""

    def __init__(self, flow: Flow, name: str) -> None:
        self.around, self.path, self.held, self.flow = flow, (*flow.path, name), [], None
        self.size = 0

    def feed(self, data: bytes) -> None:
        if not data:
            return
        self.size += len(data)
        if self.flow is None:
            self.held.append(data)
            if self.size > PIECE:
                self.flow = Flow(self.around.begin, self.around.end, self.path, self.around.found, self.around.heads)
                data, self.held = b"".join(self.held), []
        if self.flow is not None:
            self.flow.feed(data)

    def close(self) -> None:
        if self.flow is not None:
            self.flow.close()
        elif self.size:
            self.around.enter(_flat(b"".join(self.held), self.around.begin, self.around.end, self.path))
        self.held = []


class Flow:
    """A layer too large to hold, which comes bit by bit; all of it has one span in the original text.

    A window is scanned and its runs decoded; runs that reach its end begin the next window, or, if they are longer than a window,
    go to a reader. ``heads`` are digests of the first windows of this layer and those around it: a layer that begins like ``CYCLE`` of those
    around it unfolds to itself, and ends there.
    """

    def __init__(self, begin: int, end: int, path: tuple[str, ...], found: dict, heads: tuple = ()) -> None:
        self.begin, self.end, self.path, self.found, self.heads = begin, end, path, found, heads
        self.parts, self.size, self.inside, self.handled, self.readers, self.names, self.first, self.idle = [], 0, False, 0, [], set(), True, False

    def report(self, findings: list[tuple[int, int, int]], path: tuple[str, ...]) -> None:
        for _, k, _ in findings:
            self.found.setdefault((self.begin, k, self.end), (False, ">".join(path)))

    def enter(self, layer: Layer) -> None:
        """A small layer, and all below it."""
        if layer.text:
            self.report(scan_plain(layer.text), layer.path)
            for below in _layers(layer):
                below.report(self.found) if isinstance(below, Large) else self.report(scan_plain(below.text), below.path)

    def feed(self, data: bytes) -> None:
        for at in range(0, len(data), PIECE):
            if self.idle:
                return
            part = data[at:at + PIECE]
            for r in self.readers:
                r.feed(part)
            self.readers = [r for r in self.readers if not r.done]
            self.parts.append(part)
            self.size += len(part)
            if self.size >= PIECE + 2 * OVERLAP:
                self._window(last=False)

    def close(self) -> None:
        if self.size and not self.idle:
            self._window(last=True)
        for r in self.readers:
            r.close()
        self.readers, self.parts = [], []

    def _read(self, reader, window: bytes) -> None:
        reader.feed(window)
        if not reader.done:
            self.readers.append(reader)

    def _window(self, last: bool) -> None:
        window = b"".join(self.parts)
        if self.first:
            head, self.first = hashlib.blake2b(window[:PIECE], digest_size=16).digest(), False
            if self.heads.count(head) >= CYCLE:
                self.idle = True
                return
            self.heads = (*self.heads, head)
        self.report(scan_plain(window.decode("latin-1")), self.path)
        run = len(window) if last else _open_run(window)
        giant = run is None or len(window) - run > PIECE // 2
        for pattern in _RUNS:
            for m in pattern.finditer(window):
                if (m.start() or not self.inside) and (last or m.end() <= (run if run is not None else 0)):
                    data = _unsigned(m[0])
                    if data:
                        self.enter(_flat(data, self.begin, self.end, (*self.path, "base64")))
        for m in _MAGIC.finditer(window, max(0, self.handled - 15)):
            if m.end() > self.handled:
                self._read(Inflate(Gather(self, "compressed")), window[m.start():])
        for name, (pattern, part, wait) in _REWRITES.items():
            if name not in self.names and any(h in window for h in _HINTS[name]) and pattern.search(window):
                self.names.add(name)
                self._read(Rewrite(Gather(self, name), pattern, part, wait), window)
        keep = len(window)
        if not last:
            if giant and not (self.inside and run is None):
                self._read(Signs(Gather(self, "base64")), window[run or 0:])
            keep = len(window) - OVERLAP if giant else min(run, len(window) - OVERLAP)
            sign = re.compile(rb"[" + _SIGNS + rb"]")
            self.inside = bool(giant or (sign.match(window, keep - 1) and sign.match(window, keep)))
        self.handled, self.parts, self.size = len(window) - keep, [window[keep:]], len(window) - keep


def _open_run(window: bytes) -> int | None:
    """Where the run of signs begins that may go on beyond the window; its end if there is none, None if the run fills the window."""
    for back in (4096, OVERLAP, len(window)):
        found = None
        for m in _BREAK.finditer(window, max(0, len(window) - back)):
            found = m.end()
        if found is not None:
            return found
    return None


def _unsigned(run: bytes) -> bytes | None:
    """What a run of base64 signs stands for; None if it is none."""
    body = b"".join(run.split()).rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    return None if len(body) % 4 == 1 else base64.b64decode(body + b"=" * (-len(body) % 4))


def _unquoted(layer: Layer) -> Layer | None:
    """The whole layer with its URL escapes decoded; None if there are none."""
    data, begins, ends, at = [], [], [], 0

    def literal(lo: int, hi: int) -> None:
        part = layer.text[lo:hi]
        data.append(part.encode("utf-8", "replace"))
        sizes = [1] * len(part) if part.isascii() else [len(c.encode("utf-8", "replace")) for c in part]
        begins.append(np.repeat(layer.begins[lo:hi], sizes))
        ends.append(np.repeat(layer.ends[lo:hi], sizes))

    for m in _URL.finditer(layer.text):
        literal(at, m.start())
        at = m.end()
        data.append(bytes.fromhex(m[0].replace("%", "")))
        begins.append(layer.begins[m.start():at:3])
        ends.append(layer.ends[m.start() + 2:at:3])
    if not at:
        return None
    literal(at, len(layer.text))
    return Layer.of_bytes(b"".join(data), np.concatenate(begins), np.concatenate(ends), (*layer.path, "url"))


def _unicode_part(run: str) -> tuple[str, list[tuple[int, int]]]:
    if run[0] == "&":
        text = html.unescape(run)
        return text, [(0, len(run))] * len(text)
    step = {"x": 4, "u": 6, "U": 10}[run[1]] if run[2] != "{" else len(run)
    digits = (lambda s: s[3:-1]) if run[2] == "{" else (lambda s: s[2:])
    units = [int(digits(run[i:i + step]), 16) for i in range(0, len(run), step)]
    out, spans, i = [], [], 0
    while i < len(units):
        u, n = units[i], 1
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            u, n = 0x10000 + (u - 0xD800 << 10) + units[i + 1] - 0xDC00, 2
        out.append(chr(u) if u < 0x110000 and not 0xD800 <= u < 0xE000 else "�")
        spans.append((step * i, step * (i + n)))
        i += n
    return "".join(out), spans


def _substituted(layer: Layer, pattern: re.Pattern, part, name: str) -> Layer | None:
    """The whole layer with every run of the pattern decoded; None if there is no run."""
    text, begins, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        new, spans = part(m[0])
        text += [layer.text[at:m.start()], new]
        begins += [layer.begins[at:m.start()], [layer.begins[m.start() + a] for a, _ in spans]]
        ends += [layer.ends[at:m.start()], [layer.ends[m.start() + b - 1] for _, b in spans]]
        at = m.end()
    if not text:
        return None
    join = lambda parts, rest: np.concatenate([*map(np.asarray, parts), rest]).astype(np.int64)
    return Layer("".join([*text, layer.text[at:]]), join(begins, layer.begins[at:]), join(ends, layer.ends[at:]), (*layer.path, name))


def _literal_part(run: str) -> tuple[str, list[tuple[int, int]]]:
    return chr(int(run[2:], 16)) if run[1] == "x" else _SIMPLE[run[1]], [(0, len(run))]


def _decoded(layer: Layer, m: re.Match) -> Layer | None:
    """A base64 run, over one line or several."""
    signs = np.array([i for i, c in enumerate(m[0]) if c not in "=\r\n \t"]) if "\n" in m[0] else np.arange(len(m[0].rstrip("=")))
    body = "".join(m[0].split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None
    at = np.arange(len(data))
    last = np.minimum(-(-(at + 1) * 8 // 6), len(body)) - 1
    return Layer.of_bytes(data, layer.begins[m.start() + signs[at * 8 // 6]], layer.ends[m.start() + signs[last]], (*layer.path, "base64"))


def _below(layer: Layer) -> Iterator[Layer | Large | None]:
    """The layers straight below one."""
    text = layer.text
    if "%" in text:
        yield _unquoted(layer)
    if "\\" in text or "&#" in text:
        yield _substituted(layer, _UNICODE, _unicode_part, "unicode")
        if "\\x" in text:
            yield _substituted(layer, _LITERAL, _literal_part, "literal")
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(text):
            yield _decoded(layer, m)
    yield from _inflated(layer)


def _layers(root: Layer) -> Iterator[Layer | Large]:
    """All layers below one, each once for the place it begins, outermost first. The root counts as seen."""
    mark = lambda layer: (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(layer.begins[0]))
    todo, seen = deque([root]), {mark(root)} if root.text else set()
    while todo:
        for new in _below(todo.popleft()):
            if isinstance(new, Large):
                yield new
            elif new is not None and new.text and (key := mark(new)) not in seen:
                seen.add(key)
                todo.append(new)
                yield new


def unwrapped(text: str) -> Iterator[Layer | Large]:
    """All layers below a text; one that unfolds to what it came from ends there."""
    at = np.arange(len(text), dtype=np.int64)
    return _layers(Layer(text, at, at + 1, ()))


def find(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(start, kind number, end, base, layers) of all findings in a text, sorted, each span once."""
    found = {(s, k, e): (True, "") for s, k, e in scan_plain(text)}
    for layer in unwrapped(text):
        if isinstance(layer, Large):
            layer.report(found)
            continue
        for s, k, e in scan_plain(layer.text):
            found.setdefault((int(layer.begins[s]), k, int(layer.ends[e - 1])), (False, ">".join(layer.path)))
    return [(*key, *found[key]) for key in sorted(found)]


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("layers", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [[{"kind": KINDS[k], "start": s, "end": e, "base": own, "layers": path} for s, k, e, own, path in find(t or "")] for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.list_(_FINDING))], ["doc_id", "findings"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, findings) of every row: kind, start and end in code points, whether it stands in
    the text itself (base) or in which layers it was found. Sorted by start, then kind, then end.

    A null text counts as empty and has no findings. Repeated rows give equal rows.
    """
    schema = "doc_id long, findings array<struct<kind string, start long, end long, base boolean, layers string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, schema)


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with every found span, overlapping ones as one, replaced by the mark."""
    spans: list[list[int]] = []
    for s, _, e, *_ in find(text):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else redacted(t) for t in texts], dtype=object)


def redact(text: Column) -> Column:
    """The text column with its secrets replaced; null stays null."""
    return pandas_udf(_redacted, "string")(text.cast("string"))
