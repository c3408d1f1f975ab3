"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

A text is contaminated by a benchmark item if a window of the item's size has a weighted
(multiset) Jaccard similarity of at least 0.8 with it, over five-word shingles.

1. Hits. Such a window shares at least 8/9 of an item's shingles (a shorter text more than
   0.8 of the item's), so only windows that hold as many places of shingles of items of that
   size are looked at: all of them, also those between two alignments with the item. Every
   text position is tested by one join; nothing is sampled.
2. Every such window gets a 64-bit SimHash: per bit the majority over its shingles,
   repeats counted. 64 per-bit counters are summed as 32 pairs of 32-bit lanes.
3. Multi-index: eight blocks of eight bits. Fingerprints within 23 bits agree in some
   block but for two bits at most, so an item is stored under all block values within two
   flips and windows look up their eight blocks: no fingerprint within 23 is missed (the
   expected distance at similarity 0.8 is 10, deviation 3).
4. Exact weighted Jaccard verifies the candidates.

Equal texts are judged once, by digest. DataFrame functions only, on the whole path.

Cases: null, empty or wordless texts and items match nothing; a text or item of fewer
than five words is one shingle; a text shorter than the item is one window; repeated
items and repeated rows are reported each; an empty benchmark or table gives no rows;
columns of ``documents`` beyond doc_id and text are ignored, and kept by
``decontaminated``. Windows lie inside the text; of equally similar ones the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.llm.common import stored, table

WIDTH = 5
#: 100 times the least similarity.
PERCENT = 80
BLOCKS, BLOCK_BITS, FLIPS = 8, 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Rows of the sides that may be broadcast (at most 32 bytes each); larger ones are joined
#: by a shuffle.
BROADCAST_ROWS = 500_000

_SPACES = " \t\n\u000b\f\r"


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def with_shingles(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """``df`` (with text) with ``shingles``, the hashes of its word shingles in order."""
    trimmed = F.trim(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(_SPACES))
    words = F.when(F.length("__plain") > 0, F.split("__plain", f"[{_SPACES}]+"))
    hashes = F.transform(F.col("__words"), lambda w: F.xxhash64(w))
    later = [F.lit(i) for i in range(1, width)]
    run = F.transform(
        F.col("__hashes"), lambda h, i: F.xxhash64(h, *[F.get(F.col("__hashes"), i + d) for d in later])
    )
    return (
        df.withColumn("__plain", trimmed)
        .withColumn("__words", words)
        .withColumn("__hashes", hashes)
        .withColumn("shingles", F.slice(run, 1, F.greatest(F.size("__hashes") - (width - 1), F.lit(1))))
        .drop("__plain", "__words", "__hashes")
    )


def bounded(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is small by count, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash per key of rows (keys, s): bit b is set if more than half the shingles have
    it. Column ``print``."""
    lanes = 0x0000000100000001
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("size"), *[F.expr(f"sum((s >> {j}) & {lanes}L) as l{j}") for j in range(32)]
    )
    bits = [f"if(2 * (l{j} & 4294967295L) > size, 1L << {j}, 0L)" for j in range(32)]
    bits += [f"if(2 * (l{j} >>> 32) > size, 1L << {j + 32}, 0L)" for j in range(32)]
    return sums.select(*keys, "size", F.expr(" | ".join(bits)).alias("print"))


def block_values(prints: Column) -> Column:
    """The fingerprint's blocks as an array of (block, value) in one number."""
    top = 1 << BLOCK_BITS
    return F.array(
        *[
            F.lit(b * top) + F.shiftrightunsigned(prints, b * BLOCK_BITS).bitwiseAND(F.lit(top - 1))
            for b in range(BLOCKS)
        ]
    )


def near_masks() -> list[int]:
    """All flips of at most ``FLIPS`` bits of a block."""
    return [m for m in range(1 << BLOCK_BITS) if bin(m).count("1") <= FLIPS]


def window_starts(percent: int) -> str:
    """SQL for the starts of all windows of ``n`` shingles, inside a text of ``shingles``,
    that hold enough of the hit positions ``ats`` (sorted, distinct) to reach ``percent``.

    A window of w shingles needs percent / (100 + percent) * (w + n) shared ones. With hit i
    as its first, it starts after hit i - 1, at hit i at the latest, and late enough to hold
    the last hit it needs: so every start is listed once, in order."""
    whole = 100 + percent
    need = f"cast(({percent} * (least(size(shingles), n) + n) + {whole - 1}) div {whole} as int)"
    low = f"greatest(if(i = 0, 0, get(ats, i - 1) + 1), get(ats, i + {need} - 1) - n + 1)"
    high = "least(get(ats, i), greatest(size(shingles) - n, 0))"
    runs = f"transform(sequence(0, size(ats) - {need}), i -> struct({low} as low, {high} as high))"
    listed = f"flatten(transform(filter({runs}, r -> r.low <= r.high), r -> sequence(r.low, r.high)))"
    return f"if(size(ats) >= {need}, {listed}, array())"


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``digest, item_id, start, similarity``: per contaminated text (by digest) and item
    the most similar window (first shingle's position)."""
    items = stored(
        with_shingles(benchmark.select("item_id", "text"))
        .where(F.size("shingles") > 0)
        .select(F.monotonically_increasing_id().alias("item"), "item_id", "shingles"),
        "items",
    )
    item_rows = items.select("item", F.size("shingles").alias("n"), F.posexplode("shingles").alias("q", "s"))
    texts = with_shingles(docs.select(digest(F.col("text")).alias("digest"), "text")).drop("text")

    places = item_rows.select("s", "n").distinct()
    # The outer forms: Catalyst would infer a filter on an inner one, push it below the
    # projections and thereby evaluate all hashes of a text anew for each of its words.
    hits = stored(
        texts.select("digest", F.posexplode_outer("shingles").alias("at", "s"))
        .join(bounded(places), "s")
        .select("digest", "n", "at")
        .distinct()
        .groupBy("digest", "n")
        .agg(F.sort_array(F.collect_list("at")).alias("ats"))
        .where(100 * F.size("ats") >= percent * F.col("n")),
        "hits",
    )
    anchored = hits.select("digest").distinct()
    own = texts.join(bounded(anchored), "digest", "left_semi").dropDuplicates(["digest"])
    cut = stored(
        hits.join(own, "digest")
        .withColumn("starts", F.expr(window_starts(percent)))
        .where(F.size("starts") > 0)
        .withColumn("low", F.col("starts")[0])
        # Only the stretch that the windows cover is carried to each of them.
        .withColumn("stretch", F.expr("slice(shingles, low + 1, element_at(starts, -1) - low + n)"))
        .select("digest", "n", "low", "stretch", F.explode_outer("starts").alias("start"))
        .select("digest", "n", "start", F.expr("slice(stretch, start - low + 1, n)").alias("window")),
        "cut",
    )
    key = ["digest", "n", "start"]
    window_rows = cut.select(*key, F.explode("window").alias("s"))
    # Written, so that the long fingerprint expressions are not repeated in later plans.
    prints = stored(simhash(window_rows, key), "prints")
    item_prints = stored(simhash(item_rows, ["item", "n"]), "item-prints").select(
        "item", "n", F.col("print").alias("item_print")
    )
    stored_blocks = item_prints.select(
        "item", "n", "item_print", F.explode(block_values(F.col("item_print"))).alias("value")
    ).select(
        "item",
        "n",
        "item_print",
        F.explode(F.transform(F.array(*[F.lit(m) for m in near_masks()]), lambda m: F.col("value").bitwiseXOR(m))).alias(
            "value"
        ),
    )
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    candidates = (
        prints.select(*key, "print", F.explode(block_values(F.col("print"))).alias("value"))
        .join(stored_blocks, ["n", "value"])
        .where(close)
        .select(*key, "item")
        .distinct()
    )
    weights = item_rows.groupBy("item", "s").agg(F.count("*").alias("item_weight"))
    shared = (
        candidates.join(window_rows.groupBy(*key, "s").agg(F.count("*").alias("weight")), key)
        .join(weights, ["item", "s"])
        .groupBy(*key, "item")
        .agg(F.sum(F.least("weight", "item_weight")).alias("shared"))
    )
    sized = shared.join(cut.select(*key, F.size("window").alias("size")), key)
    union = F.col("size") + F.col("n") - F.col("shared")
    verified = sized.withColumn("union", union).where(100 * F.col("shared") >= percent * F.col("union"))
    best = verified.groupBy("digest", "item").agg(
        F.min(F.struct((-F.col("shared") / F.col("union")).alias("less"), F.col("start"))).alias("m")
    )
    return stored(
        best.join(items.select("item", "item_id"), "item").select(
            "digest", "item_id", F.col("m.start").alias("start"), (-F.col("m.less")).alias("similarity")
        ),
        "contaminated",
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, similarity`` of every contaminated row of ``docs``."""
    found = contaminated_texts(docs, benchmark)
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return rows.join(bounded(found), "digest").select("doc_id", "item_id", "start", "similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text no item contaminates, all columns kept."""
    found = contaminated_texts(docs, benchmark).select(F.col("digest").alias("__found")).distinct()
    return docs.join(bounded(found), digest(F.col("text")) == F.col("__found"), "left_anti")


def op2_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
