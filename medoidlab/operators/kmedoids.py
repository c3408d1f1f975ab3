"""k-medoid searches: PAM, CLARA, CLARAFAST and CLARANS.

Shape of every search:

1. bucket the rows (hash bucket, hash sample, or exact sample);
2. collapse duplicate places per bucket *before* the shuffle (partial aggregate), so a
   place holding a third of all rows is one weighted row;
3. ``repartition(bucket)`` + ``groupBy(bucket).applyInPandas``: one vectorised search
   per bucket, bucket size checked first against ``max_bucket_places``;
4. PAM/CLARANS merge the l*k bucket centres with the same search (hierarchically when
   they exceed one bucket); CLARA scores every bucket's set on the whole data in one
   pass and keeps the argmin.

Only centres (k per bucket) and scalars come back to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medoidlab.functions.geo import hash32, salt
from medoidlab.operators import kernels as K
from medoidlab.operators.assign import clara_select
from medoidlab.operators.sampling import bucketed_sample, exact_sample, exact_sample_replace, with_bucket
from medoidlab.session import cut_lineage

# Rows that a sampled bucket (or a group of the merge) is planned to hold. Not a cap: a
# bucket that turns out larger is solved all the same, in blocks of bounded memory.
BUCKET_ROWS = 20_000

MEDOID_SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.IntegerType(), False),
        T.StructField("center_id", T.IntegerType(), False),
        T.StructField("id", T.LongType(), True),
        T.StructField("lon", T.DoubleType(), False),
        T.StructField("lat", T.DoubleType(), False),
        T.StructField("phi", T.DoubleType(), False),
        T.StructField("rounds", T.IntegerType(), False),
    ]
)

STEP_SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.IntegerType(), False),
        T.StructField("phi_before", T.DoubleType(), False),
        T.StructField("phi_after", T.DoubleType(), False),
        T.StructField("cand_id", T.LongType(), True),
        T.StructField("slot", T.IntegerType(), True),
        T.StructField("improves", T.BooleanType(), False),
    ]
)

COST_SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.IntegerType(), False),
        T.StructField("cand_id", T.LongType(), False),
        T.StructField("slot", T.IntegerType(), False),
        T.StructField("phi", T.DoubleType(), False),
    ]
)


def places(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Distinct places per bucket with weight ``w`` and smallest row id ``id``."""
    return df.groupBy(bucket, "lon", "lat").agg(
        F.count(F.lit(1)).alias("w"), F.min("id").alias("id")
    )


def _solver_partitions(df: DataFrame, n_buckets: int) -> int:
    cap = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(n_buckets, max(cap, 1)))


def _dealt(pl: DataFrame) -> DataFrame:
    """Rows by bucket in as many partitions as the session has: a count that is named is not
    coalesced by the rows' few bytes, which tell nothing of a bucket's work."""
    return pl.repartition(int(pl.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "bucket")


def bucket_sizes(pl: DataFrame, bucket: str = "bucket") -> tuple[int, int]:
    """(bucket count, total places) in one job."""
    row = pl.groupBy(bucket).count().agg(F.count(F.lit(1)).alias("b"), F.sum("count").alias("t")).collect()[0]
    return int(row["b"] or 0), int(row["t"] or 0)


def full_buckets(n: int, k: int) -> int:
    """Buckets of a full search: ``floor(sqrt(n/k))`` whatever the size, as the buckets decide
    the result; one of any size is solved in memory that grows with its places."""
    return max(1, math.isqrt(n // k))


def split_buckets(keyed: DataFrame, expected: int, seed: int, limit: int) -> DataFrame:
    """Split every bucket by a second hash digit where ``expected`` rows exceed ``limit``."""
    digits = -(-expected // limit)
    if digits <= 1:
        return keyed
    inner = with_bucket(keyed.withColumnRenamed("bucket", "__outer"), digits, seed + 104729)
    return inner.withColumn("bucket", (F.col("__outer") * digits + F.col("bucket")).cast("int")).drop("__outer")


def _arrays(pdf: pd.DataFrame):
    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    return (
        pdf,
        pdf["lon"].to_numpy(np.float64),
        pdf["lat"].to_numpy(np.float64),
        pdf["w"].to_numpy(np.float64),
        pdf["id"].to_numpy(np.int64),
    )


def _pam_group(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        pdf, lon, lat, w, ids = _arrays(pdf)
        res = K.pam_search(lon, lat, w, ids, k)
        if res is None:
            return pd.DataFrame(columns=[f.name for f in MEDOID_SCHEMA.fields])
        med, phi, rounds = res
        return pd.DataFrame(
            {
                "bucket": b,
                "center_id": np.arange(k, dtype=np.int32),
                "id": ids[med],
                "lon": lon[med],
                "lat": lat[med],
                "phi": phi,
                "rounds": np.int32(rounds),
            }
        )

    return run


def pam_buckets(df: DataFrame, k: int) -> DataFrame:
    """C4: PAM in every bucket of ``df`` (needs ``bucket, id, lon, lat``).

    Output ``(bucket, center_id, id, lon, lat, phi, rounds)``: k rows per bucket with at
    least k distinct places; smaller buckets contribute nothing.
    """
    pl = places(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_buckets, _ = bucket_sizes(pl)
        pl2 = pl.repartition(_solver_partitions(pl, n_buckets), "bucket")
        # k rows per bucket: small; checkpointed so callers never rerun the search.
        return cut_lineage(pl2.groupBy("bucket").applyInPandas(_pam_group(k), MEDOID_SCHEMA))
    finally:
        pl.unpersist()


def _first_step(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        pdf, lon, lat, w, ids = _arrays(pdf)
        med = K.first_distinct(ids, k)
        if med is None:
            return pd.DataFrame(columns=[f.name for f in STEP_SCHEMA.fields])
        phi, new_phi, c, s = K.best_swap(lon, lat, w, ids, med)
        improves = c >= 0 and new_phi < phi - K.IMPROVE_TOL
        return pd.DataFrame(
            {
                "bucket": [b],
                "phi_before": [phi],
                "phi_after": [new_phi if c >= 0 else phi],
                "cand_id": [int(ids[c]) if c >= 0 else None],
                "slot": [int(s) if c >= 0 else None],
                "improves": [bool(improves)],
            }
        )

    return run


def pam_swap_step(df: DataFrame, k: int) -> DataFrame:
    """C1 (one step): from the ``pam_init`` medoids, the best single swap per bucket."""
    pl = places(df)
    return _dealt(pl).groupBy("bucket").applyInPandas(_first_step(k), STEP_SCHEMA)


def _costs(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        pdf, lon, lat, w, ids = _arrays(pdf)
        med = K.first_distinct(ids, k)
        if med is None:
            return pd.DataFrame(columns=[f.name for f in COST_SCHEMA.fields])
        mask = np.ones(len(ids), dtype=bool)
        mask[med] = False
        cand = np.nonzero(mask)[0]
        costs, _ = K.swap_costs(lon, lat, w, med, cand)
        return pd.DataFrame(
            {
                "bucket": b,
                "cand_id": np.repeat(ids[cand], k),
                "slot": np.tile(np.arange(k, dtype=np.int32), len(cand)),
                "phi": costs.reshape(-1),
            }
        )

    return run


def swap_cost(df: DataFrame, k: int) -> DataFrame:
    """Phi after each (candidate place, slot) swap from the ``pam_init`` medoids."""
    pl = places(df)
    return _dealt(pl).groupBy("bucket").applyInPandas(_costs(k), COST_SCHEMA)


def pam_init(df: DataFrame, k: int) -> DataFrame:
    """The first k distinct places of each bucket in id order (buckets with >= k).

    Uses ``row_number() <= k`` per bucket, which Spark turns into a per-partition
    group limit before the shuffle; the completeness test runs on the kept rows only.
    """
    pl = df.groupBy("bucket", "lon", "lat").agg(F.min("id").alias("id"))
    w = Window.partitionBy("bucket").orderBy("id")
    first = pl.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    full = first.withColumn("kept", F.count(F.lit(1)).over(Window.partitionBy("bucket")))
    return full.where(F.col("kept") == k).select(
        "bucket", (F.col("rn") - 1).cast("int").alias("center_id"), "id", "lon", "lat"
    )


def _merge(medoids: DataFrame, k: int, seed: int, limit: int, search) -> DataFrame:
    """Run ``search`` over bucket centres until one group is left (C7/C15). Centres are
    dealt to groups by hash rank, so group sizes differ by one at most and every level
    shrinks the table by half at least."""
    if limit < 2 * k:
        raise ValueError(f"limit {limit} is below 2k = {2 * k}: the merge would not shrink")
    cur = medoids.select("id", "lon", "lat")
    level = 0
    while True:
        # l*k centre rows: small; a reliable checkpoint stops the bucket search from
        # being recomputed by the count and the next level.
        cur = cut_lineage(cur)
        n = cur.count()
        if n == 0:
            raise ValueError("no bucket produced centres (buckets smaller than k)")
        groups = max(1, -(-n // limit))
        if groups == 1:
            one = cur.withColumn("bucket", F.lit(0))
            return search(one).select("center_id", "id", "lon", "lat")
        level += 1
        # Bucket centres only: about sqrt(n k) rows at the first level.
        order = Window.orderBy(F.xxhash64("id", F.lit(seed + 7919 * level)), "id", "lon", "lat")
        dealt = cur.withColumn("bucket", ((F.row_number().over(order) - 1) % groups).cast("int"))
        cur = search(dealt).select("id", "lon", "lat")


def _n_and_lmax(df: DataFrame, n: int | None):
    if n is None:
        n = df.count()
    return n, int(math.isqrt(n)) if n > 0 else 0


def pam(df: DataFrame, k: int, buckets: int | None = None, seed: int = 0, n: int | None = None,
        limit: int = BUCKET_ROWS) -> DataFrame:
    """PAM per bucket, then PAM again over the l*k bucket centres.

    ``buckets=None``: all rows in ``floor(sqrt(n/k))`` buckets; ``buckets=l``: a
    ``l/sqrt(n)`` hash sample in l buckets (``1 <= l <= floor(sqrt(n))``).
    Returns ``(center_id, id, lon, lat)``.
    """
    n, lmax = _n_and_lmax(df, n)
    if buckets is None:
        keyed = with_bucket(df, full_buckets(n, k), seed)
    else:
        keyed = split_buckets(bucketed_sample(df, buckets, seed, n), lmax, seed, limit)
    med = pam_buckets(keyed, k)
    return _merge(med, k, seed, limit, lambda g: pam_buckets(g, k))


def _sets_from_medoids(med: DataFrame) -> DataFrame:
    return med.select(F.col("bucket").alias("set_id"), "center_id", "lon", "lat")


def clara_from_buckets(df: DataFrame, keyed: DataFrame, k: int) -> DataFrame:
    """C11: PAM per bucket, score each set on all of ``df``, keep the best."""
    med = pam_buckets(keyed, k)
    best = clara_select(df, _sets_from_medoids(med)).collect()[0]
    return med.where(F.col("bucket") == int(best["set_id"])).select("center_id", "id", "lon", "lat")


def clara(df: DataFrame, k: int, buckets: int | None = None, sample_size: int | None = None,
          n_samples: int | None = None, seed: int = 0, n: int | None = None,
          limit: int = BUCKET_ROWS) -> DataFrame:
    """CLARA. Full (all rows, floor(sqrt(n/k)) buckets), reduced
    (``buckets=l``), or fixed samples (``sample_size`` x ``n_samples``, with replacement).
    """
    n, lmax = _n_and_lmax(df, n)
    if sample_size is not None or n_samples is not None:
        if sample_size is None or n_samples is None:
            raise ValueError("give both sample_size and n_samples")
        if sample_size >= n or sample_size < 0:
            raise ValueError(f"bad sample_size {sample_size} for {n} rows")
        if n_samples < 1:
            raise ValueError(f"bad n_samples {n_samples}")
        keyed = exact_sample_replace(df, sample_size * n_samples, seed, buckets=n_samples, n=n)
        keyed = keyed.select("bucket", "id", "lon", "lat")
    elif buckets is None:
        keyed = with_bucket(df, full_buckets(n, k), seed)
    else:
        keyed = split_buckets(bucketed_sample(df, buckets, seed, n), lmax, seed, limit)
    return clara_from_buckets(df, keyed, k)


def clarafast(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """5 exact samples of 40 + 2k rows (no replacement), CLARA selection."""
    l = 5
    keyed = exact_sample(df, l * (40 + 2 * k), seed, buckets=l)
    return clara_from_buckets(df, keyed, k)


def _clarans_group(k: int, nlocal: int, nneighbor: int, seed: int, schema=MEDOID_SCHEMA):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        pdf, lon, lat, w, ids = _arrays(pdf)
        h = pdf["h"].to_numpy(np.int64)
        res = K.clarans_search(lon, lat, w, ids, h, k, nlocal, nneighbor, seed, b)
        if res is None:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        med, phi = res
        return pd.DataFrame(
            {
                "bucket": b,
                "center_id": np.arange(k, dtype=np.int32),
                "id": ids[med],
                "lon": lon[med],
                "lat": lat[med],
                "phi": phi,
                "rounds": np.int32(0),
            }
        )

    return run


def clarans_buckets(keyed: DataFrame, k: int, nlocal: int, seed: int, n_buckets: int,
                    nneighbor: int | None = None) -> DataFrame:
    """CLARANS in every bucket; the budget comes from the mean distinct bucket size."""
    pl = places(keyed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        present, nd = bucket_sizes(pl)  # nd: T2, distinct (bucket, place) count
        if nneighbor is None:
            nneighbor = K.clarans_budget(k, nd // max(1, n_buckets))
        drawn = pl.withColumn("h", hash32("id", salt(seed, "draw")))
        pl2 = drawn.repartition(_solver_partitions(pl, max(present, 1)), "bucket")
        run = _clarans_group(k, nlocal, nneighbor, seed)
        return cut_lineage(pl2.groupBy("bucket").applyInPandas(run, MEDOID_SCHEMA))
    finally:
        pl.unpersist()


def clarans(df: DataFrame, k: int, buckets: int | None = None, nlocal: int = 3, seed: int = 0,
            n: int | None = None, limit: int = BUCKET_ROWS) -> DataFrame:
    """CLARANS per bucket, then CLARANS over the l*k bucket centres."""
    if k < 2:
        raise ValueError("CLARANS needs k >= 2")
    if not 2 <= nlocal <= 5:
        raise ValueError(f"nlocal must be in [2, 5], got {nlocal}")
    n, lmax = _n_and_lmax(df, n)
    if buckets is None:
        l = full_buckets(n, k)
        keyed = with_bucket(df, l, seed)
    else:
        l = buckets * max(1, -(-lmax // limit))
        keyed = split_buckets(bucketed_sample(df, buckets, seed, n), lmax, seed, limit)
    med = clarans_buckets(keyed, k, nlocal, seed, l)

    def merge_search(g: DataFrame) -> DataFrame:
        # C17 for the merge: the budget follows the distinct centres per group.
        pl = places(g)
        groups, nd = bucket_sizes(pl)
        nb = K.clarans_budget(k, nd // max(1, groups))
        return clarans_buckets(g, k, nlocal, seed + 1, groups, nneighbor=nb)

    return _merge(med, k, seed, limit, merge_search)


def pam_optimality(df: DataFrame, k: int, buckets: int, seed: int) -> DataFrame:
    """Check of C4: ``buckets_solved`` (those that returned exactly k centres),
    ``centers`` and ``improvable_buckets``, those of them where one more swap would
    still improve the result (expect 0)."""
    keyed = with_bucket(df, buckets, seed)
    pl = places(keyed)
    med = pam_buckets(keyed, k).select("bucket", "lon", "lat", F.lit(True).alias("is_med"))
    tagged = pl.join(med, ["bucket", "lon", "lat"], "left").fillna(False, subset=["is_med"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        pdf, lon, lat, w, ids = _arrays(pdf)
        medi = np.nonzero(pdf["is_med"].to_numpy(bool))[0]
        if len(medi) != k:
            return pd.DataFrame({"bucket": [b], "centers": [len(medi)], "improvable": [False]})
        phi, new_phi, c, s = K.best_swap(lon, lat, w, ids, medi)
        better = bool(c >= 0 and new_phi < phi - K.IMPROVE_TOL)
        return pd.DataFrame({"bucket": [b], "centers": [k], "improvable": [better]})

    parts = _solver_partitions(pl, buckets)
    res = tagged.repartition(parts, "bucket").groupBy("bucket").applyInPandas(
        run, "bucket int, centers int, improvable boolean"
    )
    return res.agg(
        F.sum(F.col("improvable").cast("bigint")).cast("bigint").alias("improvable_buckets"),
        F.sum((F.col("centers") == k).cast("bigint")).cast("bigint").alias("buckets_solved"),
        F.sum("centers").cast("bigint").alias("centers"),
    )
