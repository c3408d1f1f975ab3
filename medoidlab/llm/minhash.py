"""Near-duplicate groups by bottom-k sketches of one hash function.

A document's set is its distinct word shingles; its sketch is the ``k`` smallest shingle
hashes. Two sets of similarity s share each of their union's k smallest hashes with
probability s, so linked documents share at least ``need`` = k s - 6 sqrt(k s (1 - s))
retained values (but for one pair in 10**8).

1. Equal texts are one node (pre-aggregated by digest, so copies never meet as pairs).
2. Inverted lists of retained values. Lists are cut by the prefix rule: two sketches that
   share ``need`` values share one of the rarest ``size - need + 1`` of either, so each
   node enters only the lists of those and values that many documents hold drop out.
3. Each list is a star to its first node; components of the stars are clusters that no
   link leaves. Rows stay linear in the list lengths. Clusters larger than a block, which
   single shared values may chain together, are split: their nodes enter ``STRICT - 1``
   further lists each, linked nodes then share ``STRICT`` lists, and only pairs that do are
   edges. Lists longer than ``SHORT_LIST`` stay stars, so rows stay linear.
4. Inside a cluster (in blocks, if large; a task holds one pair of blocks) the lists give
   the overlaps of the sketches, the union sketch estimates the similarity, and exact
   Jaccard on full sets verifies. A task returns a spanning forest of its links, never
   all pairs.
5. Components of the verified links are the groups.

Cases: a null, empty or wordless text has an empty set and links with nothing; a text of
fewer words than a shingle is one shingle; rows that repeat an id and text are copies; a
null id is never a group's name unless the group has no other; an empty table gives no
rows; further columns are ignored (``near_duplicates``) or kept (``deduplicated``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medoidlab.llm.common import columns, stored, table
from medoidlab.llm.components import components
from medoidlab.llm.tokens import slices
from medoidlab.llm.words import shingle_hashes, word_hashes

SKETCH = 48
#: Lists that linked nodes of a large cluster share, and the longest list that is met in pairs.
STRICT, SHORT_LIST = 4, 64
#: Documents and shingles of one block of a cluster; a task holds two blocks.
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 2_000, 1_000_000
#: Rows of a block whose candidate pairs are held at a time.
SLAB_ROWS = 128


def need_of(size: int, percent: int) -> int:
    """Retained values that two linked sketches of ``size`` values share."""
    s = percent / 100
    return max(1, math.floor(size * s - 6 * math.sqrt(size * s * (1 - s))))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        hashes, own = shingle_hashes(*word_hashes(texts.slice(a, b - a)), width)
        out += [np.unique(hashes[x:y]) for x, y in zip(own, own[1:])]
    return out


def sketch_of(shingles: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest hashes, by their upper 62 bits (with 32, values of unrelated texts
    are equal by chance once there are millions of texts)."""
    return np.unique(shingles[:k] >> np.uint64(2)).astype(np.int64)


def _sketch(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("digest"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch_of(s, k) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "n_shingles", "sketch"],
            )

    return run


def _overlaps(rows: list[np.ndarray], split: int) -> np.ndarray:
    """Matrix of shared values between rows, by inverted lists. With ``split`` > 0 only
    rows before it against rows from it on."""
    n = len(rows)
    values = np.concatenate(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    out = np.zeros((n, n), np.int32)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1:
            held = owner[a:b]
            if split:
                at = np.searchsorted(held, split)
                if 0 < at < len(held):
                    out[held[:at, None], held[at:]] += 1
            else:
                out[held[:, None], held] += 1
    return out


def _estimate(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Share of the union sketch's values that both hold. Rows are sketches padded by
    distinct values above all others; ``sizes`` is the union sketch's size."""
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    twin = both[:, 1:] == both[:, :-1]
    rank = np.arange(both.shape[1] - 1) - np.cumsum(twin, axis=1) + twin
    return (twin & (rank < sizes[:, None])).sum(axis=1) / sizes


def links(sketches: list[np.ndarray], sets: list[np.ndarray], k: int, percent: int, split: int = 0):
    """Spanning forest of the linked pairs (positions) among the rows; with ``split``,
    among pairs across it."""
    n = len(sets)
    lengths = np.array([len(s) for s in sets])
    sizes = np.array([len(s) for s in sketches])
    shared = _overlaps(sketches, split)
    exact = None
    least = np.array([need_of(s, percent) for s in range(k + 1)])
    pads = (1 << 62) + np.arange(n)[:, None] * (k + 1) + np.arange(k)
    padded = pads.copy()
    for r, s in enumerate(sketches):
        padded[r, : len(s)] = s
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # A slab of rows at a time: the pairs held at once are bounded, all are looked at.
    for top in range(0, split or n, SLAB_ROWS):
        slab = shared[top : min(top + SLAB_ROWS, split or n)]
        i, j = np.nonzero(slab if split else np.triu(slab, top + 1))
        i += top
        small, large = np.minimum(lengths[i], lengths[j]), np.maximum(lengths[i], lengths[j])
        ok = (shared[i, j] >= least[np.minimum(sizes[i], sizes[j])]) & (100 * small >= percent * large)
        i, j = i[ok], j[ok]
        keep = [np.zeros(0, np.int64)]
        for at in range(0, len(i), 20_000):
            a, b = i[at : at + 20_000], j[at : at + 20_000]
            union = np.minimum(k, sizes[a] + sizes[b] - shared[a, b])
            keep.append(at + np.flatnonzero(_estimate(padded[a], padded[b], union) * union >= least[union]))
        keep = np.concatenate(keep)
        i, j = i[keep], j[keep]
        if len(i) > 4 * len(slab):
            exact = _overlaps(sets, split) if exact is None else exact
            common = exact[i, j]
        else:
            common = np.array(
                [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64
            )
        linked = 100 * common >= percent * (lengths[i] + lengths[j] - common)
        for a, b in zip(i[linked].tolist(), j[linked].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                yield a, b


def _verify(width: int, k: int, percent: int):
    """Rows arrive sorted by (cluster, low, high): one run of rows is one pair of blocks."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        low, high = rows[0][1], rows[0][2]
        rows = list({r[4]: r for r in rows}.values())
        rows.sort(key=lambda r: (r[3], r[4]))
        split = sum(r[3] == low for r in rows) if low != high else 0
        if low != high and split in (0, len(rows)):
            return []
        sets = shingle_sets(pa.array([r[5] for r in rows], pa.string()), width)
        sketches = [sketch_of(s, k) for s in sets]
        return [(rows[a][4], rows[b][4]) for a, b in links(sketches, sets, k, percent, split)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[s] for e in edges], pa.int64()) for s in (0, 1)], ["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("cluster", "low", "high", "block", "node", "text"))):
                if held and held[0][:3] != row[:3]:
                    edges += solve(held)
                    held = []
                held.append(row)
            yield out(edges)
        if held:
            yield out(solve(held))

    return run


def _stars(lists: DataFrame, *key: str) -> DataFrame:
    """An edge from every node of a list (the rows of equal ``key``) to the list's first."""
    pivots = lists.groupBy(*key).agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    return lists.join(pivots, list(key)).where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def _strict_edges(lists: DataFrame) -> DataFrame:
    """Edges ``a, b`` inside clusters from ``cluster, value, node, strict``: pairs of nodes that
    share so many lists as the less strict of them asks for, and the stars of long lists."""
    key = ["cluster", "value"]
    counted = stored(lists.join(lists.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), key), "counted")
    short = counted.where(F.col("n") <= SHORT_LIST).drop("n")
    other = short.select(*key, F.col("node").alias("b"), F.col("strict").alias("other"))
    pairs = (
        short.withColumnRenamed("node", "a")
        .join(other, key)
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.min(F.least("strict", "other")).alias("strict"))
        .where("n >= strict")
        .select("a", "b")
    )
    return pairs.unionByName(_stars(counted.where(F.col("n") > SHORT_LIST), *key))


def _blocks(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_DOCUMENTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
        ).alias("blocks")
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """``doc_id, digest, n_shingles, component_id, kept, keeper`` of every row of ``docs``
    (doc_id, text). ``component_id`` is the group's smallest doc_id, ``kept`` tells that
    the row has that id, ``keeper`` marks exactly one row of each group."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    sketched = stored(
        texts.select("doc_id", "digest", "text")
        .mapInArrow(_sketch(width, k), "doc_id long, digest binary, n_shingles long, sketch array<long>")
        .withColumn("uid", F.monotonically_increasing_id()),
        "sketches",
    )
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))
    nodes = stored(
        sketched.where("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min(F.struct(order.alias("o"), F.col("n_shingles"), F.col("sketch"))).alias("m"))
        .select("digest", F.col("m.o").alias("first"), F.col("m.o.uid").alias("node"), "m.n_shingles", "m.sketch"),
        "nodes",
    )
    values = nodes.select("node", F.explode("sketch").alias("value"))
    held = values.groupBy("value").count().where("count > 1")
    need = F.element_at(F.array(*[F.lit(need_of(s, percent)) for s in range(1, k + 1)]), F.col("size"))
    prefixes = (
        values.join(held, "value")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("shared"))
        .join(nodes.select("node", F.size("sketch").alias("size")), "node")
        .withColumn("prefix", F.size("shared") - need + 1)
        .where("prefix > 0")
        .withColumn("strict", F.least(need, F.lit(STRICT)))
        .select("node", "prefix", "strict", F.posexplode(F.expr("slice(shared, 1, prefix + strict - 1).value")).alias("at", "value"))
        .select("node", "value", "strict", (F.col("at") >= F.col("prefix")).alias("further"))
    )
    lists = stored(prefixes, "lists")
    stars = _stars(lists.where("not further"), "value")
    clusters = components(stars, "clusters").withColumnRenamed("root", "cluster")
    members = stored(clusters.join(nodes.select("node", "digest", "n_shingles", "first"), "node"), "members")
    blocks = _blocks(members)
    large = stored(members.join(blocks.where("blocks > 1"), "cluster", "left_semi"), "large")
    if not large.isEmpty():
        edges = _strict_edges(lists.join(large.select("node", "cluster"), "node"))
        parts = components(edges, "parts").withColumnRenamed("root", "cluster")
        small = members.join(blocks.where("blocks > 1"), "cluster", "left_anti")
        members = stored(small.unionByName(large.drop("cluster").join(parts, "node").select(*small.columns)), "members")
        blocks = _blocks(members)
    dealt = (
        members.join(blocks, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .join(texts.select("doc_id", "digest", "text"), on=["digest"])
        .where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "cluster",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block",
            "node",
            "text",
        )
    )
    key = ["cluster", "low", "high"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = stored(
        dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_verify(width, k, percent), "a long, b long"),
        "links",
    )
    roots = components(edges, "groups")
    linked = roots.join(nodes.select("node", "digest", "first"), "node")
    names = linked.groupBy("root").agg(F.min("first").alias("name"))
    grouped = linked.join(names, "root").select("digest", "name")
    named = (
        nodes.select("digest", "first")
        .join(grouped, "digest", "left")
        .select("digest", F.coalesce("name", "first").alias("name"))
    )
    return (
        sketched.join(named, "digest", "left")
        .withColumn("component_id", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("name.doc_id")))
        .select(
            "doc_id",
            "digest",
            "n_shingles",
            "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
            F.coalesce(F.col("uid") == F.col("name.uid"), F.lit(True)).alias("keeper"),
        )
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, all columns kept."""
    kept = near_duplicates(docs, width, percent).where("keeper").select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")
    )
    stay = kept.groupBy("__id", "__digest").agg(F.count("*").alias("__times"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    rows = docs.withColumns({"__own": digest, "__doc": F.col("doc_id").cast("long")})
    joined = rows.join(stay, F.col("__own").eqNullSafe(F.col("__digest")) & F.col("__doc").eqNullSafe(F.col("__id")))
    wordless = joined.where("__times > 1").select(*columns(docs))
    single = joined.where("__times = 1").dropDuplicates(["__own", "__doc"]).select(*columns(docs))
    return single.unionByName(wordless)


def op3_minhash_near_dedup(spark, sf_dir):
    rows = near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")
