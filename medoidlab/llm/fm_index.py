"""An FM-index over a list of words, and the search for all words one error away.

The words are laid out between delimiters in one text. Its suffixes are sorted once; the
sign before each suffix (the Burrows-Wheeler transform) then lets an interval of suffix
ranks be extended to the left by one sign with two binary searches. All queries of a batch
take each step together, as numpy arrays.
"""

from __future__ import annotations

import numpy as np

END, MARK = 0, 1  # signs of the text's end and of the delimiter; letters follow


def suffix_ranks(codes: np.ndarray, signs: int) -> np.ndarray:
    """Starts of the suffixes of ``codes`` in order (the last code is unique and least)."""
    n = len(codes)
    bits = max(1, int(signs).bit_length())
    depth = 62 // bits
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        if j < n:
            key[: n - j] |= codes[j:]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.empty(n, bool)
        new[0] = False
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order
        key = rank * n
        key[: n - depth] += rank[depth:]
        depth *= 2


class Index:
    """Words (distinct, not empty) between delimiters, searchable from the right end."""

    def __init__(self, words: list[str]):
        text = "\x01" + "\x01".join(words) + "\x01\x00"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        self.signs, self.n = len(self.alphabet), len(codes)
        self.suffix = suffix_ranks(codes, self.signs)
        before = codes[self.suffix - 1]
        order = np.argsort(before, kind="stable")
        self.before, self.keys = before, before[order] * self.n + order
        marks = np.flatnonzero(codes == MARK)
        self.word_at = np.full(self.n, -1, np.int64)
        self.word_at[marks[:-1]] = np.arange(len(words))

    def coded(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of signs; letters the index lacks get ``signs``."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, self.signs - 1)] == points
        return np.where(known, at, self.signs)

    def extend(self, sign, lo, hi):
        """The intervals of ``sign`` followed by what ``lo, hi`` stand for."""
        return np.searchsorted(self.keys, sign * self.n + lo), np.searchsorted(self.keys, sign * self.n + hi)

    def branches(self, lo, hi):
        """(place of the interval, letter) for every letter that stands before it."""
        wide = hi - lo > self.signs
        narrow = np.flatnonzero(~wide)
        size = (hi - lo)[narrow]
        own = np.repeat(narrow, size)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        pairs = own * self.signs + self.before[lo[own] + inside]
        all_letters = (np.flatnonzero(wide)[:, None] * self.signs + np.arange(self.signs)[None, :]).ravel()
        pairs = np.concatenate([np.unique(pairs), all_letters])
        own, letter = pairs // self.signs, pairs % self.signs
        keep = letter > MARK
        return own[keep], letter[keep]

    def one_error(self, words: list[str], exact: int) -> tuple[np.ndarray, np.ndarray]:
        """``words`` have one length. (place of the word, place of a found word), without
        repeats: found words end with the word's last ``exact`` letters and differ from it
        by one letter inserted, deleted or replaced at or before them."""
        codes = self.coded(words)
        left = codes.shape[1] - exact
        whose = np.arange(len(words))
        lo, hi = self.extend(np.int64(MARK), np.zeros(len(words), np.int64), np.full(len(words), self.n))
        for j in range(codes.shape[1] - 1, left - 1, -1):
            lo, hi = self.extend(codes[whose, j], lo, hi)
            live = hi > lo
            whose, lo, hi = whose[live], lo[live], hi[live]
        erred = [(whose[:0], lo[:0], hi[:0])]
        for j in range(left, -1, -1):
            own, letter = self.branches(lo, hi)
            a, b = self.extend(letter, lo[own], hi[own])
            live = b > a
            own, letter, a, b = own[live], letter[live], a[live], b[live]
            erred.append((whose[own], a, b))  # inserted before the rest
            if j == 0:
                break
            w, x, y = (np.concatenate(part) for part in zip(*erred))
            x, y = self.extend(codes[w, j - 1], x, y)
            live = y > x
            other = letter != codes[whose[own], j - 1]
            erred = [
                (w[live], x[live], y[live]),
                (whose[own][other], a[other], b[other]),  # replaced
                (whose, lo, hi),  # deleted
            ]
            lo, hi = self.extend(codes[whose, j - 1], lo, hi)
            live = hi > lo
            whose, lo, hi = whose[live], lo[live], hi[live]
        w, x, y = (np.concatenate(part) for part in zip(*erred))
        x, y = self.extend(np.int64(MARK), x, y)
        live = y > x
        found = self.word_at[self.suffix[x[live]]]
        pairs = np.unique(w[live] * self.n + found)
        return pairs // self.n, pairs % self.n
