"""Exact tokenizer output at dictionary speed.

The tokenizer of ``word_bpe_49k.json`` normalises (NFC, white space to one space, lower
case), splits by a pattern, and encodes every piece on its own. Texts made only of ASCII
and Latin-1 letters and signs, without ``<|``, can therefore be split here: all texts of a
batch lie in one array of bytes, the pattern's borders are found in it at once, and each
distinct piece of the batch is looked up once. Pieces not known yet are encoded by the
library, joined by spaces. Every other text goes through the library as a whole. Both ways
give the library's ids.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"

# What the vocabulary file's split pattern knows of lower-case Latin-1: runs of
# letters, single numbers, runs of other signs, and endings after an apostrophe that starts
# a piece.
_LETTERS = "abcdefghijklmnopqrstuvwxyzªµº" + "".join(map(chr, [0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)]))
_NUMBERS = "0123456789²³¹¼½¾"
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_SPACE, _LETTER, _NUMBER, _SIGN, _FOREIGN = range(5)


def _classes() -> np.ndarray:
    kinds = np.full(256, _SIGN, np.uint8)
    kinds[[*range(0, 32), *range(127, 0xA1), 0xAD]] = _FOREIGN
    kinds[list(b"\t\n\r ")] = _SPACE
    kinds[list(_LETTERS.encode("latin-1"))] = _LETTER
    kinds[list(_NUMBERS.encode("latin-1"))] = _NUMBER
    return kinds


_KIND = _classes()
#: Pieces a Python worker remembers in each of two generations: a piece that is not met
#: again while the younger one fills is forgotten.
GENERATION = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's pieces in lower-case Latin-1 bytes, and the kinds."""
    kind = _KIND[data]
    before = np.concatenate([[_SPACE], kind[:-1]]).astype(np.uint8)
    border = (kind != before) | (kind == _NUMBER)
    # An apostrophe that starts a piece takes a known ending from the letters after it.
    for at in np.flatnonzero((data == 39) & border).tolist():
        rest = data[at + 1 : at + 3].tobytes()
        for ending in _ENDINGS:
            if rest.startswith(ending):
                border[at + 1] = False
                after = at + 1 + len(ending)
                if after < len(data):
                    border[after] = True
                break
    starts = np.flatnonzero(border & (kind != _SPACE))
    borders = np.append(np.flatnonzero(border | (kind == _SPACE)), len(data))
    ends = borders[np.searchsorted(borders, starts, side="right")]
    return starts, ends, kind


class Encoder:
    """One per Python worker; ``path`` is the vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.width).tobytes()

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pieces, by the library."""
        out: list[bytes] = []
        wide = np.dtype(self.width).itemsize
        for i in range(0, len(pieces), 2000):
            part = [p.decode("latin-1") for p in pieces[i : i + 2000]]
            e = self.library.encode(" ".join(part), add_special_tokens=False)
            sizes = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            if len(sizes) == len(part):
                flat, ends = self.pack(e.ids), (np.cumsum(sizes) * wide).tolist()
                out += [flat[a:b] for a, b in zip([0, *ends], ends)]
            else:  # a piece that the library splits further
                out += [self.pack(self.library.encode(p, add_special_tokens=False).ids) for p in part]
        return out

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of distinct pieces."""
        young, old = self.young, self.old
        got = [young.get(p) for p in pieces]
        lacking = [i for i, g in enumerate(got) if g is None]
        new = []
        for i in lacking:
            ids = old.get(pieces[i])
            if ids is None:
                new.append(i)
            else:
                got[i] = young[pieces[i]] = ids
        for i, ids in zip(new, self._learn([pieces[i] for i in new])):
            got[i] = young[pieces[i]] = ids
        if len(young) > GENERATION:
            self.young, self.old = {}, young
        return got

    def _split_and_look_up(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of lower-case Latin-1 texts."""
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        starts, ends, kind = split(data)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        first = np.concatenate([[0], np.searchsorted(starts, bounds)])
        sizes = ends - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        letters = data[kind != _SPACE].tobytes()
        array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = array.dictionary_encode()
        ids = self._known(coded.dictionary.to_pylist())
        wide = np.dtype(self.width).itemsize
        pool = np.frombuffer(b"".join(ids), self.width)
        n_ids = np.array([len(x) // wide for x in ids], np.int64)
        pool_at = np.cumsum(n_ids) - n_ids
        code = coded.indices.to_numpy(zero_copy_only=False)
        each = n_ids[code]
        ends_at = np.concatenate([[0], np.cumsum(each)])
        flat = pool[np.repeat(pool_at[code] - ends_at[:-1], each) + np.arange(ends_at[-1])]
        cuts = ends_at[first].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``width``."""
        out: list[bytes | None] = [None] * len(texts)
        plain, at = [], []
        for i, text in enumerate(texts):
            try:
                coded = None if "<|" in text else text.lower().encode("latin-1")
            except UnicodeEncodeError:
                coded = None
            if coded is not None and not (_KIND[np.frombuffer(text.encode("latin-1"), np.uint8)] == _FOREIGN).any():
                plain.append(coded)
                at.append(i)
            else:
                out[i] = self.pack(self.library.encode(text, add_special_tokens=False).ids)
        if plain:
            for i, ids in zip(at, self._split_and_look_up(plain)):
                out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = 1 << 21):
    """Runs (start, end) of neighbouring texts whose bytes add up to about ``most``, so a
    task's memory is bounded by one run, or by one text if that is larger."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
