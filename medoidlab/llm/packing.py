"""Packing along a space-filling curve.

Every document's token ids (plus an end id) are hashed into a term vector, the vector is
projected to three dimensions, and the quantised projection gives a Hilbert key. The
documents are range-sorted by that key and their ids laid end to end; sequence i holds
the ids from i * size on. Neighbouring documents thus share sequences, each id lies in
exactly one piece, and only the last sequence is not full.

Cases: a null or empty text is its end id alone; a text longer than a sequence spans
several; copies and repeated rows keep ids of their own and follow each other (ties go by
doc_id, then by the row's place in the tokenised table); an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medoidlab.llm.common import ranked, stored, table
from medoidlab.llm.curve import hilbert_index
from medoidlab.llm.tokens import encoder, slices, vocabulary_path

SEQUENCE = 2048
END_ID = 1
DIMENSIONS, BITS, BINS, SEED = 3, 10, 4096, 42

TOKENISED = "doc_id long, n_ids long, curve_key long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def projection(seed: int = SEED) -> np.ndarray:
    """One Gaussian direction per dimension over the hashed term bins."""
    return np.random.default_rng(seed).standard_normal((BINS, DIMENSIONS)).astype(np.float32)


def curve_keys(docs: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's hashed term vector: id counts by bin, scaled to
    length one, projected; each coordinate is quantised by the normal distribution."""
    lengths = np.array([len(d) for d in docs])
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    bins = (flat.astype(np.int64) * 2654435761 >> 7) & (BINS - 1)
    owner = np.repeat(np.arange(len(docs), dtype=np.int64), lengths)
    both, counts = np.unique(owner * BINS + bins, return_counts=True)
    own, term = both // BINS, both % BINS
    weight = np.sqrt(counts)
    norm = np.sqrt(np.bincount(own, weight**2, len(docs)))
    coords = np.stack(
        [np.bincount(own, weight * directions[term, d], len(docs)) for d in range(DIMENSIONS)], axis=1
    ) / np.maximum(norm, 1e-9)[:, None]
    share = 1 / (1 + np.exp(-1.702 * coords))
    cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_index(cells, BITS)


def _tokenise(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, directions = encoder(path or vocabulary_path()), projection()
        end = e.pack([end_id])
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                packed = [x + end for x in e.batch(texts.slice(a, b - a).to_pylist())]
                ids = [np.frombuffer(x, e.width) for x in packed]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(curve_keys(ids, directions)),
                        pa.array(packed, pa.binary()),
                    ],
                    ["doc_id", "n_ids", "curve_key", "ids"],
                )

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            cols = (batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "begin", "ids"))
            for doc_id, n, begin, ids in zip(*cols):
                at, wide = 0, len(ids) // n
                while at < n:
                    sequence, offset = divmod(begin + at, size)
                    length = min(size - offset, n - at)
                    piece = np.frombuffer(ids[at * wide : (at + length) * wide], f"<u{wide}").astype("<u4").tobytes()
                    out.append((doc_id, at, length, zlib.crc32(piece), n, sequence, offset, piece))
                    at += length
            for i in range(0, len(out), 2000):
                cols = list(zip(*out[i : i + 2000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their ids as little-endian 32-bit integers.
    ``path`` is the vocabulary file on the executors (by default each looks up its own).

    Texts are encoded once; the ids are written once and shuffled once (the join that
    brings each document its place). The sort along the curve and the running sums move
    only (key, length) rows: totals per sorted block, then sums inside the block.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tokenised = stored(
        texts.mapInArrow(_tokenise(path, end_id), TOKENISED).withColumn("uid", F.monotonically_increasing_id()),
        "tokenised",
    )
    order = ranked(tokenised.select("curve_key", "doc_id", "uid", "n_ids"), ["curve_key", "doc_id", "uid"], "curve", "rank")
    # Blocks of fixed rank width: their totals are the only rows a global sum needs.
    block = F.expr("rank div 4096")
    order = order.withColumn("block", block)
    totals = order.groupBy("block").agg(F.sum("n_ids").alias("ids"))
    before = totals.select(
        "block", (F.sum("ids").over(Window.orderBy("block")) - F.col("ids")).alias("block_begin")
    )
    inside = F.sum("n_ids").over(Window.partitionBy("block").orderBy("rank")) - F.col("n_ids")
    begins = (
        order.select("uid", "block", inside.alias("inside"))
        .join(before, "block")
        .select("uid", (F.col("block_begin") + F.col("inside")).alias("begin"))
    )
    placed = tokenised.select("uid", "doc_id", "n_ids", "ids").join(begins, "uid").drop("uid")
    return placed.mapInArrow(_cut(size), PIECES)


def op9_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).drop("ids")
