"""Spelling variants against brute force, by index, by operator and by query."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from medoidlab.llm import spelling
from medoidlab.llm.fm_index import Index, suffix_ranks


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, n, len(near), counts.get(form)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return {w: tuple(row) for w, row in out.items()}


def got(df):
    rows = df.collect()
    found = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in rows}
    assert len(found) == len(rows)
    return found


def test_suffixes_are_sorted():
    rng = np.random.default_rng(1)
    for signs in (3, 40, 300):
        codes = np.append(rng.integers(1, signs, 500), 0)
        order = suffix_ranks(codes, signs)
        assert order.tolist() == sorted(range(501), key=lambda i: codes[i:].tolist())
    repeated = np.append(np.full(900, 2), 0)
    assert suffix_ranks(repeated, 3).tolist() == list(range(900, -1, -1))


def test_index_finds_exactly_the_errors_before_the_exact_end():
    rng = random.Random(2)
    for _ in range(25):
        letters = "abcéÿ"[: rng.randint(1, 5)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)})
        index = Index(words)
        for size in {len(w) for w in words}:
            asked = [w for w in words if len(w) == size] + ["z" * size]
            exact = size - size // 2
            own, found = index.one_error(asked, exact)
            pairs = [(asked[a], words[b]) for a, b in zip(own, found)]
            want = {
                (w, v)
                for w in asked
                for v in words
                if len(v) >= exact and v.endswith(w[size - exact :]) and one_edit(w[: size - exact], v[: len(v) - exact])
            }
            assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("cell_words", [4, 1 << 15])
def test_variants_match_brute_force_also_when_halves_are_split(spark, cell_words):
    rng = random.Random(3)
    counts = {}
    for _ in range(120):
        base = "the" + "".join(rng.choice("abñ") for _ in range(rng.randint(3, 5)))
        counts[base] = rng.choice([5, 30, 200, 1000])
        at = rng.randrange(len(base) + 1)
        counts.setdefault(base[:at] + rng.choice("abñ") + base[at:], rng.choice([5, 6, 30]))
        counts.setdefault(base[::-1], 7)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert got(spelling.spelling_variants(df, cell_words=cell_words)) == brute(counts)


def test_chains_and_ties(spark):
    counts = {"abcdef": 1, "abcdeg": 5, "abcdgg": 25, "abcggg": 125, "abgggg": 625, "zzzzzz": 3, "zzzzza": 15, "zzzzzb": 15}
    out = got(spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert out == brute(counts)
    assert out["abcdef"][4] == "abgggg" and out["zzzzzz"][0] == "zzzzza"


def test_query_on_texts_with_nulls_repeats_and_clashes(spark):
    rng = random.Random(4)
    words = ["Straße", "Straßen", "ÉCOLE", "École", "mañana", "manana", "abcdefg", "ab×÷cd", "kurz"]
    texts = [" ".join(rng.choice(words) for _ in range(60)) + ",x1y" for _ in range(60)] + [None, "", "1 2", "mañana " * 300]
    rows = [(i if i % 9 else None, t, 7, "q") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, word string")
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for i, text, *_ in rows:
        run = ""
        for ch in (text or "") + " ":
            if "a" <= ch <= "z" or "A" <= ch <= "Z" or "À" <= ch <= "ÿ":
                run += ch
                continue
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if run and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
            run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    found = spelling.vocabulary(spelling.misspelt(spelling.runs(docs)))
    assert {r.word: r.n for r in found.collect()} == counts
    assert got(spelling.spelling_variants(found)) == brute(counts)
    assert spelling.spelling_variants(spelling.vocabulary(spelling.misspelt(spelling.runs(docs.limit(0))))).count() == 0
