"""Seeded, repeatable sampling and bucketing.

Randomness comes from an md5 hash of (row id, seed, purpose), so a retried or
re-read partition gets the same keys and the draws do not depend on the partition
layout. Each purpose has its own salt: the keep/drop test and the bucket key are
independent, so kept rows are spread evenly over the buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medoidlab.functions.geo import hash32, hash_unit, salt
from medoidlab.schema import Box

# Rows per hash-range slice when a whole table gets a dense row index.
INDEX_SLICE_ROWS = 1_000_000


def hash60(value, salt_text: str) -> Column:
    """Repeatable 60-bit hash (15 hex digits of md5), for draws over > 2^32 rows."""
    c = F.col(value) if isinstance(value, str) else value
    text = F.concat(c.cast("string"), F.lit(salt_text))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def with_bucket(df: DataFrame, buckets: int, seed: int, id_col: str = "id", name: str = "bucket") -> DataFrame:
    """Bucket key in [0, buckets) from the row id."""
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    return df.withColumn(name, F.pmod(hash32(id_col, salt(seed, "bucket")), F.lit(buckets)).cast("int"))


def bernoulli_condition(fraction: float, seed: int, id_col: str = "id") -> Column:
    return hash_unit(id_col, salt(seed, "keep")) < F.lit(float(fraction))


def bernoulli_sample(df: DataFrame, fraction: float, seed: int, id_col: str = "id") -> DataFrame:
    """Keep each row with probability ``fraction`` (hash test, no replacement)."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    return df.where(bernoulli_condition(fraction, seed, id_col))


def bucketed_sample(df: DataFrame, buckets: int, seed: int, n: int | None = None, id_col: str = "id") -> DataFrame:
    """N2 + P9: sample at rate ``buckets / sqrt(n)`` and spread over ``buckets`` keys.

    Each bucket then holds about sqrt(n) rows. ``0 < buckets <= floor(sqrt(n))``.
    """
    if n is None:
        n = df.count()
    lmax = int(math.isqrt(n)) if n > 0 else 0
    if buckets < 1 or buckets > lmax:
        raise ValueError(f"buckets must be in [1, {lmax}] for {n} rows, got {buckets}")
    frac = min(1.0, buckets / math.sqrt(n))
    return with_bucket(bernoulli_sample(df, frac, seed, id_col), buckets, seed, id_col)


def exact_sample(df: DataFrame, size: int, seed: int, buckets: int | None = None, id_col: str = "id") -> DataFrame:
    """N4 (+ P10): exactly ``size`` rows without replacement (or all rows if fewer).

    Rows are ranked by a seeded hash; the top ``size`` come from a per-partition top-k
    merged in one task (``TakeOrderedAndProject``), so only ``size`` rows move. With
    ``buckets``, rows get ``draw`` (0-based rank) and round-robin ``bucket = draw % buckets``
    computed on the already-limited sample.
    """
    if size < 0:
        raise ValueError("size must be >= 0")
    key = hash32(id_col, salt(seed, "order"))
    top = df.withColumn("__h", key).orderBy("__h", id_col).limit(size)
    if buckets is None:
        return top.drop("__h")
    w = Window.orderBy("__h", id_col)
    out = top.withColumn("draw", (F.row_number().over(w) - 1).cast("bigint"))
    return out.withColumn("bucket", F.pmod(F.col("draw"), F.lit(buckets)).cast("int")).drop("__h")


def dense_index(df: DataFrame, seed: int, id_col: str = "id", n: int | None = None) -> tuple[DataFrame, int]:
    """A dense 0-based row index ``idx`` in seeded-hash order, without a global window.

    Rows fall into hash-range slices of about ``INDEX_SLICE_ROWS`` each; a window
    numbers the rows inside each slice and the slice offsets come from a per-slice
    count (one small row per slice).
    """
    if n is None:
        n = df.count()
    slices = max(1, -(-n // INDEX_SLICE_ROWS))
    h = hash32(id_col, salt(seed, "order"))
    keyed = df.withColumn("__h", h).withColumn("__s", F.floor(F.col("__h") * F.lit(slices) / F.lit(4294967296)).cast("int"))
    counts = keyed.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))
    offs = counts.select(
        "__s",
        (F.sum("__n").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))).alias("__o"),
    ).fillna(0, subset=["__o"])
    w = Window.partitionBy("__s").orderBy("__h", id_col)
    indexed = keyed.withColumn("__rn", F.row_number().over(w)).join(offs, "__s")
    out = indexed.withColumn("idx", (F.col("__o") + F.col("__rn") - 1).cast("bigint")).drop("__h", "__s", "__rn", "__o")
    return out, n


def exact_sample_replace(
    df: DataFrame, size: int, seed: int, buckets: int = 1, id_col: str = "id", n: int | None = None
) -> DataFrame:
    """N3 (+ P10): exactly ``size`` draws with replacement, round-robin into ``buckets``.

    Draw ``j`` picks row index ``hash60(j) mod n`` of :func:`dense_index`; draws are an
    equi-join on the index, so a row drawn twice appears twice. Columns added: ``draw``
    and ``bucket = draw % buckets``.
    """
    spark = df.sparkSession
    indexed, n = dense_index(df, seed, id_col, n)
    if n == 0 or size == 0:
        return indexed.limit(0).drop("idx").withColumn("draw", F.lit(0).cast("bigint")).withColumn("bucket", F.lit(0))
    draws = spark.range(size).select(
        F.col("id").alias("draw"),
        F.pmod(hash60(F.col("id"), salt(seed, "draw")), F.lit(n)).alias("idx"),
    )
    out = draws.join(indexed, "idx").drop("idx")
    return out.withColumn("bucket", F.pmod(F.col("draw"), F.lit(buckets)).cast("int"))


def uniform_points(spark: SparkSession, n: int, box: Box, seed: int, start: int = 0) -> DataFrame:
    """``n`` points uniform in ``box`` (ids ``start..start+n-1``), from hashes of the id."""
    ids = spark.range(start, start + n)
    return ids.select(
        F.col("id"),
        (F.lit(box.min_lon) + hash_unit(F.col("id"), salt(seed, "ulon")) * F.lit(box.width)).alias("lon"),
        (F.lit(box.min_lat) + hash_unit(F.col("id"), salt(seed, "ulat")) * F.lit(box.height)).alias("lat"),
    )
