"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medoidlab.session import scratch_path, ship_package

LONG = T.LongType()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder of ``spark.checkpoint.dir``
    and read back: cuts lineage, survives lost executors and keeps column pruning."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list, name: str, rank: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``rank``, the gapless position of each row in the order of ``keys``.

    The rows are range-partitioned and sorted by the keys and written once; a row's
    position is its index inside its file plus the rows of the files before it, so
    there is no window over rows (one over the files' counts only) and a key that many
    rows hold is spread by the keys after it. Rows that tie on every key
    are ordered arbitrarily but once and for all (the written files decide).
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.parquet(path)
    number = r"^part-(\d+)-.*-c(\d+)"
    file = F.col("_metadata.file_name")
    rows = spark.read.schema(df.schema).parquet(path).select(
        *columns(df),
        F.regexp_extract(file, number, 1).cast("long").alias("__part"),
        F.regexp_extract(file, number, 2).cast("long").alias("__chunk"),
        F.col("_metadata.row_index").alias("__at"),
    )
    # One row a file.
    counts = rows.groupBy("__part", "__chunk").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part", "__chunk")) - F.col("__n")
    offsets = counts.select("__part", "__chunk", before.alias("__before"))
    return (
        rows.join(F.broadcast(offsets), ["__part", "__chunk"])
        .withColumn(rank, F.col("__before") + F.col("__at"))
        .drop("__part", "__chunk", "__at", "__before")
    )


def settle(spark: SparkSession) -> None:
    """Let the driver drop the plans, generated classes and broadcasts of work that is over,
    which a long chain of stages otherwise keeps until its memory is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that would clash with names an operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[col for c, col in zip(df.columns, columns(df)) if c.lower() not in taken])
