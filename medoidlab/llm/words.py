"""Vectorised word and shingle hashes of text columns.

Words are runs of bytes outside space and 0x09-0x0D, with A-Z lowered. All texts of a
slice are hashed at once from the column's byte buffer: a word's hash is the sum of
random byte values times the weights of their places (mod 2**64), then mixed. The first 64
weights are powers of an odd base; the others are random, since long words that follow the
Thue-Morse pattern collide under the powers of any odd base. Memory is bounded by the slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = np.where(_SPACE, np.uint64(0), _BYTES[_LOWER])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _weights(n: int) -> np.ndarray:
    """An odd weight for each of ``n`` places."""
    out = mix(np.arange(1, max(n, 1) + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    powers = np.full(min(len(out), 64), _BASE, np.uint64)
    powers[0] = 1
    out[: len(powers)] = np.cumprod(powers, dtype=np.uint64)
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each text's bounds in them; nulls are empty."""
    kind = pa.large_binary()
    column = pa.array(texts).fill_null("") if texts.null_count else texts
    column = column.cast(pa.large_string()).cast(kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, and the bounds of each text among them. For every
    number in ``prefixes``, a further array of hashes of the words' first so many bytes."""
    raw, bounds = text_bytes(texts)
    space = _SPACE[raw]
    begins = ~space
    if len(raw):
        opens = np.zeros(len(raw) + 1, bool)
        opens[bounds] = True
        begins[1:] &= space[:-1] | opens[1:-1]
    starts = np.flatnonzero(begins)
    of_text = np.searchsorted(starts, bounds)
    if not len(starts):
        empty = np.zeros(0, np.uint64)
        return (empty, of_text, *[empty for _ in prefixes])
    at = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]), axis=0) if starts[0] == 0 else None
    if at is None:
        raw, space, starts = raw[starts[0] :], space[starts[0] :], starts - starts[0]
        at = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    longest = int(at.max()) + 1
    value = _VALUE[raw] * _weights(longest)[at]
    out = [mix(np.add.reduceat(value, starts))]
    for n in prefixes:
        out.append(mix(np.add.reduceat(np.where(at < n, value, np.uint64(0)), starts) + np.uint64(n)))
    return (out[0], of_text, *out[1:])


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles in order and the bounds of each text among
    them. A text of fewer words is one shingle of its own length; one of none has none."""
    lengths = np.diff(bounds)
    count = np.where(lengths == 0, 0, np.maximum(lengths - width + 1, 1))
    own = np.zeros(len(bounds), np.int64)
    np.cumsum(count, out=own[1:])
    first = np.repeat(bounds[:-1] - own[:-1], count) + np.arange(own[-1])
    size = np.minimum(np.repeat(lengths, count), width)
    total = size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    padded = np.r_[words, np.zeros(width, np.uint64)]
    factor = _weights(width + 1)
    for i in range(width):
        total += np.where(i < size, padded[first + i] * factor[i + 1], np.uint64(0))
    return mix(total), own
