"""Spelling variant grouping: words one error away, by searches in FM-indexes.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced
code point turns one into the other; a word's form is its near word of largest count (ties:
smallest in code-point order), if that count is at least ``RATIO`` times its own.

The search scheme: cut a word in halves; the error lies in one of them, so a near word
agrees with the other half exactly, either from its start or up to its end. The half is
matched exactly from the delimiter at the word's outer end, then the search extends across
the other half and allows one error there, to the other delimiter. Searches that begin at a
word's end run in an index over the words, those that begin at its start in an index over
the reversed words: the two directions of a bidirectional index. As both halves touch a
delimiter, no search has to turn around, so the two directions' intervals need not be kept
in step. A near word that agrees with both halves is counted by the first only.

Scale: words meet only if they share a half. Halves are hashed to cells of about
``CELL_WORDS`` words; a cell's words are indexed (an index for each direction and length of
half, so that a word is met once) in the task that holds it, and the queries of the cell
stream past the indexes. A half that more words share is split by hash over several cells,
and its queries go to each. Per word and index only the number of near words and
the best of them leave a task, never pairs. Chains of forms end after at most 27 steps, as
counts grow fivefold; they are followed by doubling.

Cases: null texts have no words; repeated rows count again; ties are broken as above; an
empty table or one without frequent words gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.llm.common import stored, table
from medoidlab.llm.fm_index import Index

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: Words an index holds, about.
CELL_WORDS = 1 << 15
#: Queries a batch takes through an index.
BATCH = 1 << 14

FOUND = "word string, near bigint, best_n bigint, best string"


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, run``: the maximal runs of letters of at least ``least`` code points, A-Z
    lower-cased."""
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return docs.select("doc_id", F.explode(found).alias("run")).select(
        "doc_id", F.translate("run", upper, upper.lower()).alias("run")
    )


def vocabulary(words: DataFrame, least: int = LEAST_LENGTH, often: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the rows of ``words`` (word) that are long and frequent enough."""
    return (
        words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)
    )


def _halves(words: DataFrame, from_end: bool) -> tuple[DataFrame, DataFrame]:
    """(indexed, queries): each word by the halves under which it can be found, and by the
    half it looks for. Words and halves run from the exact half's delimiter inwards."""
    size = F.length("word")
    inwards = F.reverse("word") if from_end else F.col("word")
    exact = size - F.floor(size / 2) if from_end else F.floor(size / 2)
    low = F.floor(size / 2) if from_end else F.floor((size - 1) / 2)
    lengths = F.explode(F.array(low, low + 1))
    side = F.lit(int(from_end)).alias("side")
    indexed = words.select(side, inwards.alias("inwards"), "n", lengths.alias("exact"))
    queries = words.select(side, inwards.alias("inwards"), "n", exact.alias("exact"))
    return tuple(w.withColumn("half", F.left("inwards", F.col("exact").cast("int"))) for w in (indexed, queries))


def _cell(cells: int) -> Column:
    return F.pmod(F.xxhash64("side", "half", "chunk"), F.lit(cells)).cast("int").alias("cell")


def in_cells(words: DataFrame, cells: int, cell_words: int) -> DataFrame:
    """``cell, query (0 indexed, 1 query), side, exact, chunk, inwards, n`` for both sides."""
    ends, starts = _halves(words, True), _halves(words, False)
    indexed, queries = (a.unionByName(b) for a, b in zip(ends, starts))
    # At most four rows a word are indexed, so at most 4 * words / cell_words halves are split.
    split = indexed.groupBy("side", "half").count().where(F.col("count") > cell_words)
    split = F.broadcast(split.select("side", "half", F.ceil(F.col("count") / cell_words).alias("chunks")))
    chunks = F.coalesce(F.col("chunks"), F.lit(1))
    own = F.pmod(F.xxhash64("inwards"), chunks)
    columns = [_cell(cells), "query", "side", "exact", "chunk", "inwards", "n"]
    put = indexed.join(split, ["side", "half"], "left").withColumn("chunk", own).withColumn("query", F.lit(0))
    ask = (
        queries.join(split, ["side", "half"], "left")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
        .withColumn("query", F.lit(1))
    )
    return put.select(columns).unionByName(ask.select(columns))


class _Index:
    """The words of one cell, direction, length of half and chunk, and the near words of queries."""

    def __init__(self, side: int, exact: int, counts: dict[str, int]):
        self.side, self.exact, self.words = side, exact, list(counts)
        self.counts = np.array(list(counts.values()), np.int64)
        order = np.argsort(np.array([w[::-1] if side else w for w in self.words], object))
        self.rank = np.empty(len(self.words), np.int64)
        self.rank[order] = np.arange(len(self.words))
        # The index extends from the right end: its words run outwards.
        self.index = Index([w[::-1] for w in self.words])

    def near(self, asked: list[str]) -> Iterator[tuple[str, int, int, str]]:
        """(word, near words, best count, best word) of queries of one length that have some."""
        side, words, counts = self.side, self.words, self.counts
        own, found = self.index.one_error([w[::-1] for w in asked], self.exact)
        if side:
            # What agrees with the first half too is found from the start.
            other = len(asked[0]) - self.exact
            again = np.fromiter(
                (words[f][::-1].startswith(asked[o][::-1][:other]) for o, f in zip(own.tolist(), found.tolist())),
                bool,
                len(own),
            )
            own, found = own[~again], found[~again]
        order = np.lexsort((self.rank[found], -counts[found], own))
        own, found = own[order], found[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        sizes = np.diff(np.append(first, len(own)))
        for at, size in zip(first.tolist(), sizes.tolist()):
            word, best = asked[own[at]], words[found[at]]
            if side:
                word, best = word[::-1], best[::-1]
            yield word, size, int(counts[found[at]]), best


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, query): a cell's words, then the queries that meet them."""
    at, words, indexes, waiting = None, {}, {}, {}

    def answer(group):
        asked, index = waiting.pop(group), group[:3]
        if index in words:
            indexes[index] = _Index(*index[:2], words.pop(index))
        rows = list(indexes[index].near(asked)) if index in indexes else []
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
            ["word", "near", "best_n", "best"],
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cell", "query", "side", "exact", "chunk", "inwards", "n")]
        for c, query, side, exact, chunk, inwards, n in zip(*columns):
            if c != at:
                for group in list(waiting):
                    yield answer(group)
                at = c
                words.clear()
                indexes.clear()
            if not query:
                words.setdefault((side, exact, chunk), {})[inwards] = n
                continue
            group = (side, exact, chunk, len(inwards))
            asked = waiting.setdefault(group, [])
            asked.append(inwards)
            if len(asked) >= BATCH:
                yield answer(group)
    for group in list(waiting):
        yield answer(group)


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """``word, n, n_near, best_n, best`` of every row of ``words`` (word, n; distinct words
    without null)."""
    spark = words.sparkSession
    cells = max(1, -(-4 * words.count() // cell_words))
    parts = min(cells, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    rows = in_cells(words, cells, cell_words)
    found = (
        rows.repartitionById(parts, F.col("cell") % parts)
        .sortWithinPartitions("cell", "query")
        .mapInArrow(_search, FOUND)
    )
    blank = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).alias("best_n"), F.lit(None).alias("best"))
    all_rows = found.select("word", F.lit(None).cast("long").alias("n"), "near", "best_n", "best").unionByName(
        blank.select("word", "n", "near", F.col("best_n").cast("long"), F.col("best").cast("string"))
    )
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best"))))
    return (
        all_rows.groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
        .select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))
    )


def with_roots(words: DataFrame) -> DataFrame:
    """``words`` (word, form, ...) with ``root``, the last of the chain of forms."""
    links = stored(words.where("form is not null").select("word", F.col("form").alias("up")), "forms")
    while True:
        over = links.select(F.col("word").alias("up"), F.col("up").alias("further"))
        step = links.join(over, "up", "left").select(
            "word", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")
        )
        step = stored(step, "forms")
        links = step.select("word", "up")
        if step.where("moved").isEmpty():
            break
    return words.join(links, "word", "left").withColumn("root", F.coalesce("up", "word")).drop("up")


def spelling_variants(words: DataFrame, ratio: int = RATIO, cell_words: int = CELL_WORDS) -> DataFrame:
    """``words`` (word, n; distinct) -> word, form, root, n, n_near, form_n."""
    near = near_words(words, cell_words)
    takes = F.col("best_n") >= ratio * F.col("n")
    formed = near.select(
        "word", "n", "n_near", F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")
    )
    return with_roots(stored(formed, "near-words")).select("word", "form", "root", "n", "n_near", "form_n")


def misspelt(found: DataFrame) -> DataFrame:
    """The contract's words: runs of which a few lose one code point, by CRC-32 of
    ``doc_id:run`` (a null id is empty)."""
    digest = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.left("run", at), F.substr("run", at + 2))
    return found.withColumn("h", digest).select(
        F.when(F.col("h") % 199 == 0, less).otherwise(F.col("run")).alias("word")
    )


def op11_spelling_variants(spark, sf_dir):
    words = vocabulary(misspelt(runs(table(spark, sf_dir, "documents"))))
    return spelling_variants(stored(words, "vocabulary"))
