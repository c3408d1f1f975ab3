"""Training-data operators against brute force on small fixtures, and their edge cases."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medoidlab.llm import cover_tree, decontamination, html_text, minhash, packing, preferences, sharding, token_counts, topk
from medoidlab.llm import toxicity, warc
from medoidlab.llm.components import components
from medoidlab.llm.curve import hilbert_index
from medoidlab.llm.tokens import Encoder, vocabulary_path
from medoidlab.llm.words import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from medoidlab.session import local_session

    return local_session("*", 8, app="medoidlab-tests")


def documents(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in more.items()})


def corpus():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 120))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        for _ in range(3):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c))
    return texts + [texts[0], texts[0].upper(), None, "", " \t\n", "one", "one two", "one", "a " * 3000]


def sets(text, width):
    w = (text or "").encode().lower().split()
    return [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        index = hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_word_hashes_see_bytes_and_bounds():
    texts = pa.array(["A b c", "a", None, "", "  b C \n a", "ab"])
    words, bounds = word_hashes(texts)
    assert bounds.tolist() == [0, 2, 3, 3, 3, 5, 6]
    assert words[0] == words[2] == words[4]
    assert words[1] == words[3]
    assert len(set(words.tolist())) == 3
    hashes, own = shingle_hashes(words, bounds, 2)
    assert own.tolist() == [0, 1, 2, 2, 2, 3, 4] and hashes[0] != hashes[2]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, width, percent):
    texts = corpus()
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shingles = [set(sets(t, width)) for t in texts]
    for i, a in enumerate(shingles):
        for j in range(i):
            if a and shingles[j] and 100 * len(a & shingles[j]) >= percent * len(a | shingles[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    rows = minhash.near_duplicates(documents(spark, texts, uid="x", node=1), width, percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id) == (len(shingles[r.doc_id]), find(r.doc_id)), r.doc_id
        assert r.kept == (r.doc_id == r.component_id)
    kept = minhash.deduplicated(documents(spark, texts, uid="x"), width, percent)
    assert kept.columns == [*DOCS.replace(",", "").split()[::2], "uid"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in range(len(texts)) if find(i) == i)


def test_long_words_after_a_pattern_differ(spark):
    """Words after the Thue-Morse pattern and its complement, and texts without a common shingle."""
    even = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    odd = even.translate(str.maketrans("ab", "ba"))
    for size in (64, 1024, 4096):
        words, _ = word_hashes(pa.array([even[:size], odd[:size]]))
        assert words[0] != words[1]
    texts = [f"{even[:1024]} x {odd[:1024]} y z", f"{odd[:1024]} x {even[:1024]} y z"]
    rows = minhash.near_duplicates(documents(spark, texts), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(0, 3, 0), (1, 3, 1)]


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    rows = [(None, "x y z q"), (None, "x y z q"), (3, "x y z q"), (3, "x y z q"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df).collect()
    assert sorted((r.component_id is None, r.keeper) for r in out) == [(False, False)] * 3 + [(False, True), (True, True)]
    assert minhash.deduplicated(df).count() == 2
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_large_cluster_in_blocks_finds_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    rows = []
    for _ in range(60):
        s = base.copy()
        s[rng.choice(100, rng.integers(0, 12), replace=False)] = rng.integers(0, 1 << 62, 1)[0]
        rows.append(np.unique(s))
    sketches = [minhash.sketch_of(s, 48) for s in rows]
    want = {
        (i, j)
        for j in range(60)
        for i in range(j)
        if 100 * len(np.intersect1d(rows[i], rows[j])) >= 85 * len(np.union1d(rows[i], rows[j]))
    }

    def closure(edges):
        parent = list(range(60))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(60)]

    whole = list(minhash.links(sketches, rows, 48, 85))
    assert set(whole) <= want and closure(whole) == closure(want)
    parts = []
    for low, high in ((range(30), range(30)), (range(30), range(30, 60)), (range(30, 60), range(30, 60))):
        at = list(low) if low == high else [*low, *high]
        found = minhash.links([sketches[i] for i in at], [rows[i] for i in at], 48, 85, 0 if low == high else len(low))
        parts += [(at[a], at[b]) for a, b in found]
    assert closure(parts) == closure(want)


def test_sketch_values_are_wide():
    """Hashes that agree in their upper 32 bits only are different values."""
    near = np.array([1 << 40, (1 << 40) + 8, (1 << 40) + 16], np.uint64)
    assert len(minhash.sketch_of(near, 48)) == 3
    rows = [np.unique(np.r_[near[i], np.arange(1, 41, dtype=np.uint64) << np.uint64(58 - i)]) for i in range(3)]
    assert list(minhash.links([minhash.sketch_of(r, 48) for r in rows], rows, 48, 85)) == []


def test_large_clusters_are_split_where_too_few_lists_are_shared(spark):
    chain = [(1, v, n, 4) for v in range(30) for n in (v, v + 1)]  # neighbours share one list
    pair = [(1, 100 + v, n, 4) for v in range(4) for n in (50, 51)]
    third = [(1, 100 + v, 52, 4) for v in range(3)]  # one list too few
    lenient = [(1, 200, 60, 1), (1, 200, 61, 4)]  # a short text needs one
    hot = [(1, 300, n, 4) for n in range(1000, 1000 + minhash.SHORT_LIST + 1)]
    other = [(2, 300, 2000, 4), (2, 301, 2001, 4)]
    rows = spark.createDataFrame(
        chain + pair + third + lenient + hot + other, "cluster int, value long, node long, strict int"
    )
    edges = {(r.a, r.b) for r in minhash._strict_edges(rows).collect()}
    assert {tuple(sorted(e)) for e in edges} == {(50, 51), (60, 61)} | {(1000, n) for _, _, n, _ in hot[1:]}


def test_near_duplicates_with_split_clusters_match_brute_force(spark, monkeypatch):
    texts = corpus()[:70]
    shingles, root = [set(sets(t, 3)) for t in texts], list(range(70))
    for i, a in enumerate(shingles):
        for j in range(i):
            if 100 * len(a & shingles[j]) >= 85 * len(a | shingles[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    calls, strict = [], minhash._strict_edges
    monkeypatch.setattr(minhash, "_strict_edges", lambda lists: calls.append(1) or strict(lists))
    monkeypatch.setattr(minhash, "BLOCK_DOCUMENTS", 2)
    rows = minhash.near_duplicates(documents(spark, texts), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(root))
    assert calls and len(set(root)) < 70


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    rows = components(spark.createDataFrame(edges, "a long, b long"), "t").collect()
    got = {r.node: r.root for r in rows}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    words = ["v%d" % i for i in range(300)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(14, 60))) for _ in range(12)] + ["a b c", "", None]
    texts = []
    for item in items[:12]:
        w = item.split()
        for edits in range(4):
            c = list(w)
            for _ in range(edits):
                at = rng.randrange(len(c))
                c[at : at + 1] = rng.choice([[rng.choice(words)], [c[at], "new"], []])
            around = [[rng.choice(words) for _ in range(rng.randint(0, 40))] for _ in range(2)]
            texts.append(" ".join(around[0] + c + around[1]))
    texts += [items[0].upper(), "A  b\nc", "a b", None, "", " ".join(items[1].split()[:10])]
    want = set()
    for d, t in enumerate(texts):
        s = sets(t, 5)
        for i, item in enumerate(items):
            n = len(sets(item, 5))
            target = collections.Counter(sets(item, 5))
            for at in range(max(1, len(s) - n + 1)):
                window = collections.Counter(s[at : at + n])
                shared = sum((window & target).values())
                if shared and 5 * shared >= 4 * (sum(window.values()) + n - shared):
                    want.add((d, i))
    docs = documents(spark, texts, n="x", digest=1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == want
    clean = decontamination.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_finds_windows_between_alignments(spark):
    rng = random.Random(21)
    word = lambda k: ["u%d" % rng.randrange(10**6) for _ in range(k)]
    first, second, item = word(27), word(27), word(58)
    texts = [word(30) + second + first + word(30)]
    texts.append(word(31) + word(1) + item[1:29] + word(2) + item[29:-1] + word(1) + word(33))
    texts += [first + second, word(9) + item + word(9) + item[:50] + word(5), item[3:55], (word(2) * 40)[:60], item[:20]]
    items = [first + second, item, texts[-2][:30], item[:54]]
    want = {}
    for d, t in enumerate(texts):
        s = sets(" ".join(t), 5)
        for i, x in enumerate(items):
            target = collections.Counter(sets(" ".join(x), 5))
            n = sum(target.values())
            for at in range(max(1, len(s) - n + 1)):
                window = collections.Counter(s[at : at + n])
                shared, size = sum((window & target).values()), sum(window.values())
                if 9 * shared >= 4 * (size + n):
                    want[d, i] = max(want.get((d, i), (0, 0)), (shared / (size + n - shared), -at))
    assert want[0, 0] == (46 / 54, -30) and want[1, 1] == (0.8, -32)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = decontamination.contaminated(documents(spark, [" ".join(t) for t in texts]), bench).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, -r.start) for r in rows} == want and len(rows) == len(want)


def test_simhash_index_covers_the_radius():
    masks = decontamination.near_masks()
    assert len(masks) == 37 and decontamination.RADIUS == 23
    rng = random.Random(2)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 23))
        assert any((flips >> (8 * b)) & 255 in masks for b in range(8))


def test_top_products_keep_rows_that_share_an_id(spark):
    rows = [(100, [1.0, 0.0]), (5, [0.5, 0.0]), (5, [0.9, 0.0]), (6, [0.7, 0.0]), (6, [0.7, 0.0]), (200, [0.1, 0.0])]
    rows += [(200, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_products(df, F.col("vec_id") % 100 == 0, pivots=2).collect()
    v = [np.floor(1024 * np.array(x)).astype(int) for _, x in rows]
    want = []
    for q in (0, 5, 6):
        order = sorted((-int(v[q] @ v[i]), rows[i][0]) for i in range(7) if i != q)
        want += [(rows[q][0], n, i, -s) for n, (s, i) in enumerate(order, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_cover_tree_covers_separates_and_nests():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(c, s, (700, 2)) for c, s in ((0, 1), (30, 3), (90, 0.1))])
    root = cover_tree.build(points, leaf=20)
    todo, seen, inner = [root], 0, 0
    while todo:
        node = todo.pop()
        gaps = np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1))
        assert gaps.max() <= node.radius <= node.cover * (1 + 1e-6)
        if not node.children:
            seen += len(node.rows)
            continue
        inner += 1
        centres = np.array([c.centre for c in node.children])
        cover = node.children[0].cover
        assert cover <= node.cover / cover_tree.BASE * (1 + 1e-9) and (centres[0] == node.centre).all()
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
        assert apart.min() > cover
        assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        todo += node.children
    assert seen == len(points) and inner > 10


def test_encoder_gives_the_library_ids():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary_path()), Encoder(vocabulary_path())
    rng = random.Random(3)
    alphabet = "abcXYZ  \t\n'stvemld0129.,!?-<|>éÀßñ²½ªµ ́中😀ΣıİǅǄ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["'start it's'll ..'s 's ''s a'\n's 1'm ½'re² x\x85y x\xa0y \x01 a'", "'re", "'", "ç'd'd"]
    texts += ["", "it's we'll <|endoftext|> x", "<|startoftext|>", "I'VE 123", "a" * 5000, "café café"]
    for text, packed in zip(texts, own.batch(texts)):
        assert np.frombuffer(packed, own.width).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_counts_encode_only_misses(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    texts = ["Some text", " Some \n text ", "Some text", None, "", "<|endoftext|> a", "é à", "x  y"]
    docs, cache = documents(spark, texts, digest="clash"), str(tmp_path / "cache")
    for _ in range(2):
        for r in token_counts.token_counts(docs, vocabulary_path(), cache).collect():
            text = texts[r.doc_id] or ""
            assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
            assert r.n_bytes == len(text.encode())
    assert spark.read.parquet(cache).count() == 5
    version = token_counts.tokenizer_version(vocabulary_path())
    assert token_counts.misses(docs, token_counts.stored_counts(spark, cache, version)).count() == 0
    assert token_counts.token_counts(docs.limit(0), vocabulary_path(), cache).count() == 0


def test_packing_is_an_exact_cut(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    texts = corpus() + ["word " * 5000]
    rows = packing.pack(documents(spark, texts, ids=1, rank=2), vocabulary_path()).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r.start)
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids
        assert all(r.doc_tokens == len(ids) for r in own)
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for s, parts in fill.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or s == max(fill)
    assert packing.pack(documents(spark, texts).limit(0), vocabulary_path()).count() == 0


def test_shards_are_even_and_gapless(spark):
    texts = ["t%d" % i for i in range(101)] + [None, "t1", "t1"]
    docs = documents(spark, texts, shard="clash").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    rows = sharding.document_shards(docs, shards=8)
    got = collections.defaultdict(list)
    for r in rows.collect():
        got[r.shard].append(r.slot)
    sizes = [len(v) for v in got.values()]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1 and set(got) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    assert sharding.document_shards(docs.limit(0)).count() == 0
    assert sharding.document_shards(docs.limit(3)).select("shard").distinct().count() == 3


def test_archive_round_trip(spark, tmp_path):
    pages = [(5, "http://a", "same"), (2, "http://b\r\nWARC-Type: x", "same"), (2, "http://c", "same"), (7, None, None)]
    pages += [(8, "http://d", ""), (9, "http://e", "é" * 1000), (None, "http://f", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    rows = warc.read_archive(spark, path).collect()
    assert spark.read.parquet(path + "/blobs").count() == 3
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows if r.payload == b"same") == [
        (0, "revisit", 2),
        (2, "response", None),
        (2, "response", None),
        (5, "revisit", 2),
    ]
    for r in rows:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[size:] == b"\r\n\r\n"
        body = rest[:size].partition(b"\r\n\r\n")[2]
        assert body == (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert head.count(b"WARC-Type") - (b"%0D" in head) == 1
    warc.write_archive(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_archive_notices_changed_bytes(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), path)
    spark.read.parquet(path + "/blobs").withColumn("payload", F.lit(b"y")).write.parquet(path + "/changed")
    spark.read.parquet(path + "/changed").write.mode("overwrite").parquet(path + "/blobs")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()


def test_top_products_match_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (300, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(300, None), (301, [float("nan")] * 8), (302, [1.0, None] * 4), (None, [0.5] * 8), (400, [1.0, 2.0]), (500, [3.0, 1.0])]
    rows += [(7, x[7].tolist()), (303, [float("inf")] * 8), (304, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x"))
    got = topk.top_products(df, F.col("vec_id") % 50 == 0, pivots=4).collect()
    v = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    want = set()
    for q in range(0, 300, 50):
        order = sorted((-int(v[q] @ v[i]), i) for i in range(300) if i != q)[:10]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(order, 1)}
    s = 1024 * 1024 * (1 * 3 + 2 * 1)
    want |= {(400, 1, 500, s), (500, 1, 400, s)}
    # Row 7 is there twice: both are candidates, each a row of its own.
    copied = set()
    for q in range(0, 300, 50):
        order = sorted((-int(v[q] @ v[i]), i) for i in [*range(300), 7] if i != q)[:10]
        copied |= {(q, n, i, -s) for n, (s, i) in enumerate(order, 1)}
    assert {tuple(r) for r in got} == copied | {r for r in want if r[0] >= 400}
    assert topk.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_machine_learns_pairs_and_scores_empty_texts(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(800):
        words = ["n%d" % rng.randrange(50) for _ in range(15)]
        kind = rng.randrange(4)
        words += [[], ["fool"], ["folk"], ["fool", "folk"]][kind]
        texts.append(" ".join(words))
        labels.append((i, int(kind == 3)))
    docs = documents(spark, texts + [None, ""], score="clash")
    known = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, known)).collect()
    assert len(out) == 802
    held = [(r.predicted, labels[r.doc_id][1]) for r in out if r.doc_id < 800 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out) and all(r.predicted == 0 for r in out if r.doc_id >= 800)
    nothing = toxicity.score(docs, toxicity.train(docs, known.limit(0))).agg(F.max("score")).first()[0]
    assert nothing < 0.01
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), known)).count() == 0


def test_toxicity_on_held_out_documents(spark):
    from medoidlab.llm.common import table

    sf = "/root/testdata/sf0.1"
    rows = toxicity.op1_fm_toxicity(spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    area = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert area > 0.95
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(good)


def test_rendering():
    r = html_text.render
    assert r("") == "" and r("plain  text") == "plain text"
    assert r("<title>no</title><p>One<p>two &amp; <b>th</b>ree<br>four") == "One\n\ntwo & three\nfour"
    assert r("<ul><li>a<li>b<ol><li>c<li>d</ol></ul>end") == "- a\n- b\n  1. c\n  2. d\n\nend"
    assert r("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>") == "Name       Qty\napple pie  3"
    assert r("<div hidden>x</div><p style='DISPLAY : none'>y</p><script>if (a<b) '</p>'</script>z") == "z"
    assert r("<pre>x\n  y\n\nz</pre>") == "x\n  y\n\nz"
    assert r("a<!-- never closed <p>b") == "a" and r("</div></b>a</p>b") == "a\n\nb"
    assert r("<script>open") == "" and r("1 < 2 && 3 > 2") == "1 < 2 && 3 > 2"
    deep = r("<div>" * 5000 + "x" + "</div>" * 5000 + "<blockquote>q</blockquote>")
    assert deep.split() == ["x", "q"]
    assert r("<td " * 20000).startswith("<td")


def test_rendering_of_comments_lists_spans_and_captions():
    text = html_text.render
    assert text("a<!-->b<!-- x -->c<!--->d<!-- y --!>e<!-- z") == "abcde"
    assert text("<ol start=5><li>a<li value=9>b<li>c</ol>") == "5. a\n9. b\n10. c"
    assert text("<input type=submit value='Send &amp; go'>x<input type=hidden value=no><input value=typed>") == "Send & go x"
    assert text("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>") == "ab     c\n1   2  3"


def test_tables_stay_linear_in_the_page():
    for wide, tall in ((30_000, 10_000), (390, 5000)):
        page = f"<table><tr><td>{'x' * wide}<td>{'y<br>' * tall}<tr><td>a<td>b</table>"
        out = html_text.render(page)
        assert out.count("y") == tall and "x" * wide in out and len(out) <= 402 * (tall + 3) + wide
    many = "<table><tr>" + "<td>cell" * 3000 + "<td>" + "z<br>" * 3000 + "</table>"
    assert len(html_text.render(many)) < 2 * len(many)


def test_rendering_ends_an_open_head():
    r = html_text.render
    assert r("<html><head><title>t</title><p>Hello <b>you</b>") == "Hello you"
    assert r("<head><meta charset=x>\n<style>a</style> Hello<div>you") == "Hello\nyou"
    assert r("<head><title>t</title><noscript>n</noscript>\n</head>\n<body>x") == "x"
    assert r("<head><head><script>s</script>&nbsp;a<br>b").split() == ["a", "b"]


def test_rendering_keeps_cells_outside_a_table():
    r = html_text.render
    assert r("<tr><td>x</td><td>y</td></tr><tr><th>z") == "x\ny\nz"
    assert r("<table><tr><td>a</table></table><tr><td>b<p>c</td></tr>d") == "a\n\nb\n\nc\nd"
    assert r("<ul><li><td>x</ul>") == "- x"


def test_rendering_ends_tags_with_stray_quotes():
    r = html_text.render
    assert r("<a title=don't>Visible</a> and it's <b>x</b>") == "Visible and it's x"
    assert r('<a href="x"">Visible</a><b class="y">z</b>') == "Visiblez"
    assert r('a<i title="open>b</i>c') == "abc" and r("a <b c") == "a <b c"
    assert r("<p title='a>b' hidden>no</p><img alt = \"x > y's\"><i class=a/b>z") == "x > y'sz"
    assert r("<img src=data:" + "x" * 30_000 + "'" * 30_000 + ">ok") == "ok" and r("<a " + "b='c' " * 300_000 + ">ok") == "ok"


def test_rendering_shows_formulas_drawings_and_choices():
    r = html_text.render
    assert r("so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds") == "so x=2 holds"
    svg = "<svg><title/><defs><text>no</text></defs><path d=a/b /><desc>no</desc><text x='1'>A</text><text>B</text></svg>"
    assert r(f"a{svg}c") == "a A B c"
    assert r("x<select><option>a<option selected>b &amp; c<option>d</select>y") == "x b & c y"
    assert r("<select><optgroup label=g><option>a<option>b</optgroup></select>") == "a"
    assert r("<select multiple><option>a<option label=L>b</select>c") == "a\nL\nc"
    assert r("<select><option>a<option>b<p>after") == "a\n\nafter" and r("<select hidden><option>a</select>b") == "b"
    assert r("<option>a</option>b").split() == ["a", "b"]


def test_rendering_hides_at_every_depth():
    r = html_text.render
    deep, out = "<div>" * 300, "</div>" * 300
    assert r(deep + "<script>s<p></script><style>t</style><i hidden>u</i>x" + out + "y") == "x\ny"
    assert r("<div hidden>" + deep + out + "no</div>y") == "y"
    assert r(deep + "<table><tr><td>a<td>b</table><ul><li>c<li>d</ul>" + out).split() == ["a", "b", "c", "d"]
    assert r("<p><button>" + "<b>" * 20_000 + "<div></p></i>" * 20_000 + "x") == "x"


def test_rendering_keeps_every_row(spark):
    df = spark.createDataFrame([(1, None), (1, "<p>x"), (None, "y")], "page_id long, html string").withColumn("text", F.lit(0))
    rows = html_text.extracted(df).collect()
    assert sorted((r.page_id or 0, r.text) for r in rows) == [(0, "y"), (1, ""), (1, "x")]
    assert html_text.extracted(df.limit(0)).count() == 0


def test_preferences(spark):
    rows = [(1, 0, 0, "user", "hi"), (1, 0, 1, "assistant", "good"), (1, 1, 1, "assistant", "bad <|user|>"), (1, 1, 0, "user", "hi")]
    rows += [(2, 0, 0, None, None), (2, 1, 0, None, None), (3, 0, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "pair_id long, side int, turn long, role string, text string").withColumn("prompt", F.lit(1))
    got = {r.pair_id: r for r in preferences.format_preferences(df).collect()}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].prefix_turns == 1
    assert got[1].chosen == "<|assistant|>\ngood<|end|>\n" and got[1].rejected == "<|assistant|>\nbad < |user|><|end|>\n"
    for side in ("chosen", "rejected"):
        a, b = map(int, got[1][side + "_mask"].split("-"))
        assert got[1][side][a:b].endswith("<|end|>\n") and got[1][side][:a] == "<|assistant|>\n"
    assert (got[2].prefix_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert (got[3].prompt, got[3].rejected, got[3].rejected_mask) == ("", None, None)
    assert preferences.format_preferences(df.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_reach_the_end(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.run(spark, sf).count() > 0
