"""Secret scans through nested encodings: a recursive decoding worklist.

A text is scanned for three kinds of secrets, and so is every layer that can be unwrapped
from it: percent escapes, Unicode escapes (``\\uXXXX``, ``\\u{X}``, ``\\UXXXXXXXX``,
``\\xXX``, ``&#N;``, ``&#xN;``), base64 (both alphabets, every alignment of a run, so a
run glued to other letters is found; wrapped lines are joined) and compressed bytes
(gzip, zlib, bzip2, xz, zstandard). Layers wait in a worklist; each one is scanned and
unwrapped in turn until none is left. A layer whose bytes and place were seen before is
not entered again, which ends cycles such as an archive that holds itself.

Every byte of a layer knows the code points of the document it came from, so a match is
reported as a span of the document: ``kind, start, end`` in code points, end exclusive,
the whole match (for ``assign`` the key word too). Bytes of a compressed layer stand for
its whole container. The spans of the text itself (the base) are always kept; layers only
add spans, and one that several layers give counts once, with the path of the first.

Cases: a null text is empty and has no spans; rows are scanned one by one, so repeated
ids, copies and hot sources change nothing; an empty table gives no rows; other columns
are ignored. Texts are scanned whole. A line feed ends every match, so escapes are
unwrapped line by line. A document's decoded layers may add up to ``LAYER_BYTES`` (a
defence against archive bombs); a document that would pass that has ``complete`` false,
and the spans found up to there. No shuffle; a task holds one batch of texts.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medoidlab.llm.common import table

# The three kinds with their patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    rb"(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    rb"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: The shortest match (``token=`` and six characters) has 12 bytes: 16 signs of base64.
LEAST_MATCH = 12
LAYER_BYTES = 64 << 20

_PERCENT = re.compile(rb"%([0-9A-Fa-f]{2})")
_UNICODE = re.compile(
    rb"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    rb"|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});"
)
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}")
_WRAPPED = re.compile(rb"(?:[A-Za-z0-9+/_-]{60,}\r?\n)+[A-Za-z0-9+/_-]+")
_ONE_ALPHABET = bytes.maketrans(b"-_", b"+/")
_READABLE = re.compile(rb"[\x20-\x7e]{%d,}" % LEAST_MATCH)
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")

FOUND = "array<struct<kind:string,start:bigint,end:bigint,path:string>>"


def matches(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the secrets in ``data``, leftmost and not overlapping per kind."""
    for m in _ASSIGN.finditer(data):
        if m.end(1) - m.start(1) >= LEAST_VALUE:
            yield 0, m.start(), m.end()
    for m in _ACCESS.finditer(data):
        if m.end() - m.start() >= LEAST_ACCESS:
            yield 1, m.start(), m.end()
    for m in _HEX.finditer(data):
        yield 2, m.start(), m.end()


class Layer:
    """Bytes with, for each, the range of the document's code points it stands for."""

    __slots__ = ("data", "lo", "hi", "path")

    def __init__(self, data: bytes, lo: np.ndarray, hi: np.ndarray, path: str):
        self.data, self.lo, self.hi, self.path = data, lo, hi, path

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.lo[start:end].min()), int(self.hi[start:end].max())

    def part(self, start: int, end: int) -> Layer:
        return Layer(self.data[start:end], self.lo[start:end], self.hi[start:end], self.path)


def _escaped_lines(data: bytes, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Bounds of the lines that hold a match of ``pattern``."""
    at = 0
    while m := pattern.search(data, at):
        start = data.rfind(b"\n", 0, m.start()) + 1
        end = data.find(b"\n", m.end())
        end = len(data) if end < 0 else end
        yield start, end
        at = end


def _replaced(line: Layer, pattern: re.Pattern, value, path: str) -> Layer:
    """``line`` with each match of ``pattern`` replaced by the bytes ``value`` gives for it."""
    out, lo, hi, at = [], [], [], 0
    for m in pattern.finditer(line.data):
        new = value(m)
        if new is None:
            continue
        a, b = m.span()
        out += [line.data[at:a], new]
        low, high = line.span(a, b)
        lo += [line.lo[at:a], np.full(len(new), low)]
        hi += [line.hi[at:a], np.full(len(new), high)]
        at = b
    out.append(line.data[at:])
    return Layer(
        b"".join(out), np.concatenate([*lo, line.lo[at:]]), np.concatenate([*hi, line.hi[at:]]), line.path + path
    )


def _percent(m: re.Match) -> bytes:
    return bytes([int(m[1], 16)])


def _code_point(m: re.Match) -> bytes | None:
    if m[4]:
        return bytes([int(m[4], 16)])
    point = int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16)
    return chr(point).encode("utf-8", "replace") if point < 0x110000 else None


def _base64(run: Layer) -> Iterator[Layer]:
    """The bytes of every alignment of a run that may hold something to scan or unwrap."""
    signs = run.data.translate(_ONE_ALPHABET)
    for shift in range(4):
        n = len(signs) - shift
        n -= n % 4 == 1
        raw = base64.b64decode(signs[shift : shift + n] + b"=" * (-n % 4))
        if _READABLE.search(raw) or _PACKED.search(raw):
            first = np.arange(len(raw)) * 4 // 3 + shift
            last = (np.arange(1, len(raw) + 1) * 4 + 2) // 3 + shift - 1
            yield Layer(raw, run.lo[first], run.hi[last], run.path + ">base64")


def _opened(packed: bytes, most: int) -> tuple[bytes, bool] | None:
    """(content, whole) of compressed bytes, at most ``most`` of them; None if they are not."""
    try:
        if packed.startswith(b"BZh"):
            d = bz2.BZ2Decompressor()
            out = d.decompress(packed, most)
            return out, d.eof or d.needs_input
        if packed.startswith(b"\xfd7zXZ"):
            d = lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=256 << 20)
            out = d.decompress(packed, most)
            return out, d.eof or d.needs_input
        if packed.startswith(b"\x28\xb5"):
            import zstandard

            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(packed) as reader:
                out = reader.read(most)
                return out, not reader.read(1)
        d = zlib.decompressobj(47)
        out = d.decompress(packed, most)
        return out, not d.unconsumed_tail
    except Exception as fault:
        # Bytes that only look like an archive are no layer; what else fails is a fault.
        if type(fault).__name__ in ("error", "ZstdError", "LZMAError", "OSError", "EOFError", "ValueError"):
            return None
        raise


def _unwrapped(layer: Layer, base: bool, room: int) -> Iterator[Layer | None]:
    """The layers one step below; None stands for one that did not fit into ``room``."""
    data = layer.data
    for pattern, value, path in ((_PERCENT, _percent, ">url"), (_UNICODE, _code_point, ">unicode")):
        for a, b in _escaped_lines(data, pattern):
            yield _replaced(layer.part(a, b), pattern, value, path)
    for m in _BASE64.finditer(data):
        yield from _base64(layer.part(*m.span()))
    for m in _WRAPPED.finditer(data):
        block = layer.part(*m.span())
        keep = np.flatnonzero(~np.isin(np.frombuffer(block.data, np.uint8), (10, 13)))
        joined = block.data.replace(b"\r", b"").replace(b"\n", b"")
        yield from _base64(Layer(joined, block.lo[keep], block.hi[keep], block.path))
    if base:
        return  # a text holds no bytes that were compressed and not encoded
    for m in _PACKED.finditer(data):
        opened = _opened(data[m.start() :], room + 1)
        if opened is None or not opened[0]:
            continue
        content, whole = opened
        if not whole or len(content) > room:
            yield None
            continue
        low, high = layer.span(m.start(), len(data))
        yield Layer(
            content,
            np.broadcast_to(np.int64(low), len(content)),
            np.broadcast_to(np.int64(high), len(content)),
            layer.path + ">compressed",
        )


_MAY_UNWRAP = re.compile(_PERCENT.pattern + rb"|" + _BASE64.pattern + rb"|\\[uUx]|&#")


def scan(data: bytes, most: int = LAYER_BYTES) -> tuple[list[tuple[int, int, int, str]], int, bool]:
    """Spans (start, kind, end, path) of a text's UTF-8 bytes in order, the number of
    layers that were unwrapped, and whether all were."""
    base = list(matches(data))
    deep = _MAY_UNWRAP.search(data)
    if not base and not deep:
        return [], 0, True
    if data.isascii():
        point = np.arange(len(data))
    else:
        point = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    spans = {(int(point[a]), kind, int(point[b - 1]) + 1): "" for kind, a, b in base}
    if not deep:
        return [(*k, p) for k, p in sorted(spans.items())], 0, True
    work, seen, layers, room, complete = deque([Layer(data, point, point + 1, "")]), set(), 0, most, True
    while work:
        layer = work.popleft()
        for child in _unwrapped(layer, not layer.path, room):
            if child is None or len(child.data) > room:
                complete = False
                continue
            if len(child.data) < LEAST_MATCH:
                continue
            place = child.lo[:: max(1, len(child.lo) // 64)].tobytes()
            mark = hashlib.blake2b(child.data + b"\0" + place, digest_size=16).digest()
            if mark in seen:
                continue
            seen.add(mark)
            layers += 1
            room -= len(child.data)
            for kind, a, b in matches(child.data):
                low, high = child.span(a, b)
                spans.setdefault((low, kind, high), child.path[1:])
            if _MAY_UNWRAP.search(child.data) or _PACKED.search(child.data):
                work.append(child)
    return [(*k, p) for k, p in sorted(spans.items())], layers, complete


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())])
    for batch in batches:
        found, layers, complete = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            spans, n, whole = scan(text.as_py() or b"")
            found.append([{"kind": KINDS[k], "start": a, "end": b, "path": p} for a, k, b, p in spans])
            layers.append(n)
            complete.append(whole)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.list_(kind_of)), pa.array(layers, pa.int64()), pa.array(complete)],
            ["doc_id", "found", "n_layers", "complete"],
        )


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``found``, the spans in order of
    (start, kind, end) with the path of encodings (empty: the text itself), ``n_layers``
    unwrapped and ``complete``."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_scan_batches, f"doc_id {kind}, found {FOUND}, n_layers bigint, complete boolean")


def _listed(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op13_secret_scan(spark, sf_dir):
    """Counts and digest of the spans of the text itself, and all spans as text."""
    found = secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["path"] == "")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        "n_layers",
        "complete",
    )
