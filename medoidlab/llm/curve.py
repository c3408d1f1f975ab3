"""Hilbert curve index of quantised points, and quantisers for metadata columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points in ``[0, 2**bits)**d``.

    ``cells`` is (n, d); ``d * bits`` may be 62 at most. Works on all rows at once:
    from the top bit down, each axis is reflected or exchanged with the first one as
    the curve turns; the Gray-coded bits are then interleaved, first axis highest.
    """
    x = np.array(cells, dtype=np.int64).T.copy()
    d = len(x)
    if d * bits > 62:
        raise ValueError("d * bits may be 62 at most")
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            up = (x[i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def hilbert_column(cells: list[Column], bits: int) -> Column:
    """The curve index as a column over integer cell columns."""

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in cols], axis=1), bits))

    return index(*[c.cast("int") for c in cells])


def hashed_cell(c: Column, bits: int) -> Column:
    """Cell of a categorical value; null takes cell 0."""
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("int")


def log_cell(c: Column, bits: int, top: int = 1 << 32) -> Column:
    """Cell of a non-negative number on a log scale up to ``top``; null takes cell 0."""
    import math

    scaled = F.floor(F.log2(F.lit(1.0) + F.greatest(c.cast("double"), F.lit(0.0))) * ((1 << bits) / math.log2(top + 1)))
    return F.coalesce(F.least(scaled, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")
