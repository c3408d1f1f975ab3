"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, digest, n_tokens), append only. A text's key is
the SHA-256 of its normalised form (runs of space, tab, CR and LF become one space, ends
are trimmed: the tokenizer drops white space, so the count is the same) together with
the tokenizer's version digest. Only distinct texts whose key is not stored are encoded;
their counts are appended, and all documents take their count by a join.

Cases: a null text is empty; empty texts count 0; copies, also those that differ in
white space only, are encoded once; a hot text is merged before the shuffle; a key that
two writers appended is read once; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.llm.common import table
from medoidlab.llm.tokens import encoder, slices, vocabulary_path
from medoidlab.session import scratch_path

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\r\n]+", " "))


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        wide = 2 if e.width == "<u2" else 4
        for batch in batches:
            texts = batch.column("text")
            counts: list[int] = []
            for a, b in slices(texts):
                counts += [len(x) // wide for x in e.batch(texts.slice(a, b - a).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts)), batch.column("digest"), pa.array(counts, pa.int64())],
                ["tokenizer", "digest", "n_tokens"],
            )

    return run


def stored_counts(spark, cache: str, version: str) -> DataFrame:
    """The cache's counts of one tokenizer version, one row a digest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def misses(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct normalised texts (digest, text) that have no stored count."""
    texts = docs.select(normalised(F.col("text")).alias("text"))
    distinct = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").dropDuplicates(["digest"])
    return distinct.join(stored.select("digest"), "digest", "left_anti")


def token_counts(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs`` (doc_id, text). Encodes and
    appends to ``cache`` what it lacks."""
    spark = docs.sparkSession
    version = tokenizer_version(path)
    new = misses(docs, stored_counts(spark, cache, version))
    new.mapInArrow(_encode(path, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    keys = docs.select(
        "doc_id",
        F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
    )
    return keys.join(stored_counts(spark, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens")


def op6_token_counts(spark, sf_dir):
    counts = token_counts(table(spark, sf_dir, "documents"), vocabulary_path(), scratch_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
