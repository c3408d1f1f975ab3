"""The pipeline's stages keep every column of the rows they keep, whatever its name."""

import corpus_pipeline
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_filtering_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = {"score": F.col("doc_id") + 0.5, "predicted": F.lit("kept"), "a.b": F.lit("dot"), "digest": F.lit(1)}
    docs = docs.withColumns(more).unionByName(
        docs.limit(1).withColumns(more).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r["a.b"] == "dot" and r.predicted == "kept" and r.digest == 1 for r in rows), name
        assert all(r.score == r.doc_id + 0.5 for r in rows if r.doc_id is not None), name
        assert sum(r.doc_id is None for r in rows) == 1, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
