"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and distinct word prefixes (a stem stands for its
inflected forms), hashed into 2**18 buckets. The machine scores

    logit = bias + sum_i w_i + sum_{i<j} <v_i, v_j>

over the terms present; the pair sum is linear in the terms, by
((sum v)**2 - sum v**2) / 2. It learns which terms are bad and which are bad together.

Training takes at most ``MAX_TRAINING_ROWS`` labelled rows (those with the smallest hash
of their id; terms are extracted on the executors) and terms that ``MIN_ROWS`` of them
hold. Scoring reads every whole text in one pass without a shuffle; the model is a fixed
(1 + FACTORS) * 2**18 floats.

Cases: a null or empty text has no terms and scores the bias; repeated words count once;
rows with a null id are scored and not held out; several labels of one id count as the
largest; null labels are left out; no usable labels of both classes gives a constant
score (near 1 if all labels are toxic, else near 0); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.llm.common import table, without
from medoidlab.llm.tokens import slices
from medoidlab.llm.words import word_hashes

BUCKET_BITS = 18
PREFIX = (5,)
FACTORS = 4
MAX_TRAINING_ROWS = 12_000
MIN_ROWS = 4
FOLDS = 5


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of each text, text after text, and the owner of each."""
    words, bounds, *stems = word_hashes(texts, PREFIX)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(bounds))
    shift = np.uint64(64 - BUCKET_BITS)
    keys = np.concatenate([(owner << np.uint64(BUCKET_BITS)) | (h >> shift) for h in (words, *stems)])
    keys = np.unique(keys)
    return (keys & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32), (keys >> np.uint64(BUCKET_BITS)).astype(np.int64)


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    for a, b in slices(texts):
        yield texts.slice(a, b - a)


class Machine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def logits(self, term: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(owner, self.w[term], n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            out += 0.5 * (np.bincount(owner, x, n) ** 2 - np.bincount(owner, x * x, n))
        return out

    def scores(self, term: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(term, owner, n), -30, 30)))


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    epochs: int = 6,
    batch: int = 64,
    rate: float = 0.1,
    sparsity: float = 0.5,
    toxic_weight: float = 6.0,
    seed: int = 3,
) -> Machine:
    """AdaGrad on the weighted logistic loss over rows of term buckets; every step
    shrinks the touched weights towards zero (soft threshold ``sparsity`` times the
    term's rate), so terms that only tell single training texts apart end at zero."""
    size, rng = 1 << BUCKET_BITS, np.random.default_rng(seed)
    w, v = np.zeros(size), np.zeros((size, FACTORS))
    share = float(np.mean(labels)) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Machine(30.0 if share else -30.0, w, v)
    held = np.bincount(np.concatenate(rows), minlength=size)
    used = np.flatnonzero(held >= MIN_ROWS)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    w_used, v_used = np.zeros(len(used)), rng.normal(0, 0.01, (len(used), FACTORS))
    seen_w, seen_v, seen_b = np.ones(len(used)), np.ones((len(used), FACTORS)), 1.0
    bias = float(np.log(share / (1 - share)))

    def step(value: np.ndarray, seen: np.ndarray, grad: np.ndarray, speed: float):
        seen = seen + grad * grad
        pace = speed / np.sqrt(seen)
        moved = value - pace * grad
        return np.sign(moved) * np.maximum(np.abs(moved) - pace * sparsity, 0), seen

    for epoch in range(epochs):
        speed = rate / (1 + 0.1 * epoch)
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            term = np.concatenate([rows[j] for j in some])
            owner = np.repeat(np.arange(len(some)), [len(rows[j]) for j in some])
            error = Machine(bias, w_used, v_used).scores(term, owner, len(some)) - labels[some]
            error *= np.where(labels[some] == 1, toxic_weight, 1.0)
            touched, slot = np.unique(term, return_inverse=True)
            g = error[owner]
            for f in range(FACTORS):
                x = v_used[:, f]
                total = np.bincount(owner, x[term], len(some))
                grad = np.bincount(slot, g * (total[owner] - x[term]), len(touched))
                v_used[touched, f], seen_v[touched, f] = step(x[touched], seen_v[touched, f], grad, speed)
            grad = np.bincount(slot, g, len(touched))
            w_used[touched], seen_w[touched] = step(w_used[touched], seen_w[touched], grad, speed)
            drift = float(error.sum())
            seen_b += drift * drift
            bias -= speed * drift / np.sqrt(seen_b)
    w[used], v[used] = w_used, v_used
    return Machine(bias, w, v)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Machine:
    """Learn from labels (doc_id, toxic) outside fold 0. The labelled ids are bounded
    first, so the documents are filtered by a broadcast of at most ``max_rows`` ids."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    sample = (
        known.groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = [], 0
            for part in pieces(b.column("text")):
                term, owner = terms(part)
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                out += [term[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
                at += len(part)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("toxic").cast(pa.int32()), pa.array(out, pa.binary())],
                ["doc_id", "toxic", "terms"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        m = fit([np.frombuffer(t, np.int32) for _, _, t in got], np.array([float(y) for _, y, _ in got]))
        w, v = (x.astype(np.float32).tobytes() for x in (m.w, m.v))
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([w]), pa.array([v])], ["bias", "w", "v"])

    found = rows.mapInArrow(extract, "doc_id long, toxic int, terms binary")
    once = found.groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms"))
    # At most max_rows rows: one task fits the model, and only the model reaches the driver.
    model = once.coalesce(1).mapInArrow(learn, "bias double, w binary, v binary").first()
    if model is None:
        return fit([], np.zeros(0))
    w, v = (np.frombuffer(bytes(x), np.float32) for x in (model.w, model.v))
    return Machine(model.bias, w, v.reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine, name: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with the columns ``name`` (0 to 1) and ``predicted`` (1 from 0.5 on), which
    take the place of columns of those names."""
    base = without(docs, name, predicted)
    # The closure carries the model: it lives as long as the plan that uses it.
    bias, w, v = machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        m = Machine(bias, w, v)
        column = pa.array(texts, pa.string(), from_pandas=True)
        out = [np.zeros(0)]
        for part in pieces(column):
            out.append(m.scores(*terms(part), len(part)))
        return pd.Series(np.concatenate(out))

    # Not deterministic to Catalyst: a filter on the score must not run the model twice.
    rows = base.withColumn(name, scored.asNondeterministic()(F.coalesce(F.col("text"), F.lit(""))))
    return rows.withColumn(predicted, (F.col(name) >= 0.5).cast("int"))


def op1_fm_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return score(docs, train(docs, labels)).select("doc_id", held_out, "score", "predicted")
