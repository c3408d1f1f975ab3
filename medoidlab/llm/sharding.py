"""Sharding along a Hilbert curve over quantised metadata.

Several metadata dimensions are quantised, each row gets its index along the Hilbert
curve through those cells, the rows are sorted by that index, and the sorted run is cut
into shards of equal row counts. A shard then covers a compact box of every dimension,
so file statistics prune on any of them.

Cases: a null dimension takes cell 0; a null text has size 1 (no bytes plus 1); rows
with one cell (a hot source, copies) are ordered by id, then by a hash of the text, so a
hot cell is cut like any other run; repeated rows keep a slot each; an empty table gives
no rows; columns of the input named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.llm.common import ranked, table, without
from medoidlab.llm.curve import hashed_cell, hilbert_column, log_cell

ADDED = ("curve_index", "curve_rank", "shard", "slot")


def hilbert_shards(
    docs: DataFrame,
    cells: list[Column],
    bits: int,
    shards: int,
    ties: list[Column],
) -> DataFrame:
    """``docs`` with ``curve_index``, ``curve_rank``, ``shard`` (0 to ``shards`` - 1) and
    ``slot`` (gapless from 0 in the shard). Row counts of shards differ by one at most.

    One shuffle (the range sort); positions come from the written, sorted files.
    """
    base = without(docs, *ADDED).withColumn("curve_index", hilbert_column(cells, bits))
    rows = ranked(base, ["curve_index", *ties], "shards", "curve_rank")
    n = rows.count()
    # Shard i holds the ranks from ceil(i * n / shards) on.
    shard = F.expr(f"(curve_rank * {shards}L) div {max(n, 1)}L")
    return rows.withColumn("shard", shard.cast("int")).withColumn(
        "slot", F.expr(f"curve_rank - ((cast(shard as bigint) * {n}L + {shards - 1}L) div {shards}L)")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard. The rows already lie in curve order, so a task writes to
    the one or two shards that its run touches and nothing is shuffled again."""
    sharded.write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 8, bits: int = 8) -> DataFrame:
    """Documents by language, source and length."""
    cells = [hashed_cell(F.col("lang"), bits), hashed_cell(F.col("source"), bits), log_cell(F.length("text"), bits)]
    return hilbert_shards(docs, cells, bits, shards, [F.col("doc_id"), F.xxhash64("text")])


def op4_hilbert_sharding(spark, sf_dir):
    rows = document_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
