"""Trip and position sources and sinks.

* raw trips: CSV with a header, every column a string, no inference pass;
* cleaned positions: JSON lines named like the original bean getters
  (``id``, ``pickupLatitude``, ``pickupLongitude``), or Parquet;
* ``trips_from_orders``: the raw-trip table derived from the driver's ``orders``
  table (the test data has no coordinates of its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medoidlab.functions.geo import hash32
from medoidlab.schema import POSITION_JSON_SCHEMA, POSITION_SCHEMA, TRIP_COLUMNS


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """Raw trip CSV. Columns are bound by header name, all strings. Only the first
    file's header is read ahead; a file whose header differs from it is an error, never
    rows under wrong names."""
    header = spark.read.option("header", True).csv(path).schema
    df = spark.read.option("header", True).schema(header).option("enforceSchema", False).csv(path)
    return df.select(*TRIP_COLUMNS)


def read_positions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Cleaned positions, explicit schema, renamed to (id, lon, lat)."""
    if fmt == "json":
        df = spark.read.schema(POSITION_JSON_SCHEMA).json(path)
        return df.select(
            F.col("id"),
            F.col("pickupLongitude").alias("lon"),
            F.col("pickupLatitude").alias("lat"),
        )
    if fmt == "parquet":
        return spark.read.schema(POSITION_SCHEMA).parquet(path)
    raise ValueError(f"unknown positions format {fmt!r}")


def write_positions(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """S3: write cleaned positions; by default fails when the path exists."""
    if fmt == "json":
        out = df.select(
            F.col("id"),
            F.col("lat").alias("pickupLatitude"),
            F.col("lon").alias("pickupLongitude"),
        )
        out.write.mode(mode).json(path)
    elif fmt == "parquet":
        df.select("id", "lon", "lat").write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown positions format {fmt!r}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the session."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a path is a file or a folder that holds anything."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath)) and len(fs.listStatus(hpath)) > 0


def load_positions(
    spark: SparkSession,
    raw_path: str,
    cache_path: str | None,
    fmt: str = "parquet",
) -> DataFrame:
    """Read the cleaned copy if present, else clean the raw trips and save them.

    After writing, the cleaned copy is read back, so later plans start at a short
    scan instead of re-parsing the raw CSV.
    """
    from medoidlab.operators.clean import clean_trips

    # A copy counts only when its writer has ended: a batch leaves _SUCCESS, a stream its
    # metadata log. Anything else is the rest of a broken write and is written anew.
    ended = cache_path and any(path_exists(spark, f"{cache_path}/{x}") for x in ("_SUCCESS", "_spark_metadata"))
    if ended:
        return read_positions(spark, cache_path, fmt)
    if not path_exists(spark, raw_path):
        raise FileNotFoundError(f"raw trip data not found: {raw_path}")
    cleaned = clean_trips(read_trips(spark, raw_path))
    if not cache_path:
        return cleaned
    # Only the rest of an unfinished write is replaced, never files of somebody else.
    if has_files(spark, cache_path) and not path_exists(spark, f"{cache_path}/_temporary"):
        raise FileExistsError(f"{cache_path} holds files but no finished copy")
    write_positions(cleaned, cache_path, fmt, mode="overwrite")
    return read_positions(spark, cache_path, fmt)


def positions_from_rows(spark: SparkSession, rows) -> DataFrame:
    """An in-memory list of (id, lon, lat) as a positions DataFrame."""
    return spark.createDataFrame(list(rows), POSITION_SCHEMA)


def write_results(df: DataFrame, path: str, mode: str = "append", fmt: str = "csv",
                  max_k: int | None = None) -> None:
    """Write a results table in one job (append by default). The CSV form has two
    columns per centre: tables appended to one folder name the same ``max_k``, which the
    files already there must have too."""
    if fmt == "csv":
        from medoidlab.plans.sweep import results_wide

        wide = results_wide(df, max_k)
        if mode == "append" and path_exists(df.sparkSession, f"{path}/_SUCCESS"):
            there = df.sparkSession.read.option("header", True).csv(path).columns
            if there != wide.columns:
                raise ValueError(f"{path} holds {len(there)} columns, not {len(wide.columns)}: name the same max_k")
        wide.write.mode(mode).option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "json":
        df.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown results format {fmt!r}")


def trips_from_orders(orders: DataFrame) -> DataFrame:
    """Raw trips derived from the ``orders`` table, one trip per order.

    Coordinates are assembled from integers as text so the same strings come out of
    Spark and DuckDB. About 2/3 of rows have another call type, 5% an empty track,
    4% a latitude below 41 and some longitudes fall on both sides of the box.
    """
    key = F.col("o_orderkey")
    h_p = hash32(key, "p")
    h_x = hash32(key, "x")
    h_q = hash32(key, "q")
    h_y = hash32(key, "y")
    call_type = F.when(key % 3 == 0, "A").when(key % 3 == 1, "B").otherwise("C")
    lon_txt = F.lpad((F.lit(380000) + h_x % 340000).cast("string"), 6, "0")
    lat_head = F.when(h_q % 25 == 0, F.lit("40.")).otherwise(F.lit("41."))
    lat_txt = F.lpad((h_y % 350000).cast("string"), 6, "0")
    polyline = F.when(h_p % 20 == 0, F.lit("[]")).otherwise(
        F.concat(
            F.lit("[[-8."),
            lon_txt,
            F.lit(","),
            lat_head,
            lat_txt,
            F.lit("],[-8.600000,41.150000]]"),
        )
    )
    cols = {c: F.lit(None).cast("string") for c in TRIP_COLUMNS}
    cols["TRIP_ID"] = key.cast("string")
    cols["CALL_TYPE"] = call_type
    cols["POLYLINE"] = polyline
    # The row is emitted through a one-element generator: filters on POLYLINE then stop
    # at the generator instead of being rewritten onto the hash expressions, so each
    # hash runs once per order rather than once per predicate.
    row = F.struct(*[cols[c].alias(c) for c in TRIP_COLUMNS])
    return orders.select(F.inline(F.array(row)))


def trips_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips for one scale-factor directory of the driver tables.

    A small single-file ``orders`` table is spread over the session's cores before
    the (hash-heavy) derivation; a large table keeps its own splits.
    """
    from medoidlab.session import spread

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return trips_from_orders(spread(orders))
