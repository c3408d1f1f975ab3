"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept;
its result is written as Parquet and read again as the next stage's ``docs``. All but
the last return the columns of ``documents``, and any further column as it is, whatever
its name.

Cases: null and empty texts pass the three filters (they score the model's bias, have no
shingles and no passage) and pack as an end mark alone. Of rows equal in id and text, and
of near-duplicates, one row stays (the smallest id; ties by the row's place in the input);
rows with a null id are kept, judged and packed like others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medoidlab.llm.common import columns, settle, stored, table
from medoidlab.llm.decontamination import decontaminated
from medoidlab.llm.minhash import deduplicated
from medoidlab.llm.packing import pack
from medoidlab.llm.toxicity import score, train

# Packing ends in the hands of a tokenizer library, which SQL cannot express.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic."""
    settle(spark)
    machine = train(docs, table(spark, sf_dir, "labels"))
    judged = score(docs, machine, "__toxic_score", "__toxic")
    return judged.where("__toxic = 0").select(*columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    settle(spark)
    return deduplicated(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    settle(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, along the curve."""
    settle(spark)
    return pack(docs).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
