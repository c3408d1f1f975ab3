"""Nearest-centre assignment and objective values.

Centres are few (k rows) and travel as literals inside the expression, so assigning
points never shuffles and never joins: each row computes one distance per centre,
takes their ``least`` and the first centre reaching it. Ties go to the lower centre
index, as with a strict ``<`` scan.

Many centre sets (CLARA scoring) are scored in one pass: one array element per set,
exploded inside the same stage and summed with a partial + final aggregate, so only
one row per set and partition is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.functions.geo import haversine
from medoidlab.session import cut_lineage

# Largest centre table accepted as literals in one plan; larger tables of centre sets are
# scored in batches of about half as many centres.
MAX_LITERAL_CENTERS = 1 << 16
# Up to this many centres the distances are unrolled into columns; above, one literal
# array is folded, which grows the work with k but not the plan.
UNROLLED_CENTERS = 8
# Tables of more centres than this are indexed (``center_index``).
INDEXED_CENTERS = 512
# Centre sets scored per pass over the data in ``objective_many``.
SETS_PER_PASS = 8192


Centers = Sequence[tuple[float, float]]


def planar(lon1, lat1, lon2, lat2) -> Column:
    """Squared distance in degrees, the metric of a k-means model."""
    lon1, lat1, lon2, lat2 = (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
                              for x in (lon1, lat1, lon2, lat2))
    return (lon1 - lon2) * (lon1 - lon2) + (lat1 - lat2) * (lat1 - lat2)


# What "nearest" is measured in: great-circle metres, or squared degrees.
METRICS = {"haversine": haversine, "planar": planar}


def as_center_list(centers) -> list[tuple[int, float, float]]:
    """(center_id, lon, lat) triples from a list of (lon, lat) or a centres DataFrame."""
    if isinstance(centers, DataFrame):
        cols = centers.columns
        key = "center_id" if "center_id" in cols else None
        sel = [F.col(key) if key else F.lit(None), "lon", "lat"]
        # One job: fetch at most one row past the limit, so the size check is proven.
        rows = centers.select(*sel).limit(MAX_LITERAL_CENTERS + 1).collect()
        if len(rows) > MAX_LITERAL_CENTERS:
            raise ValueError(f"more than {MAX_LITERAL_CENTERS} centres; pass fewer centres")
        if key:
            rows = sorted(rows, key=lambda r: r[0])
            return [(int(r[0]), float(r[1]), float(r[2])) for r in rows]
        return [(i, float(r[1]), float(r[2])) for i, r in enumerate(rows)]
    out = []
    for i, c in enumerate(centers):
        if len(c) == 3:
            out.append((int(c[0]), float(c[1]), float(c[2])))
        else:
            out.append((i, float(c[0]), float(c[1])))
    return out


def _center_array(chunk: list[tuple[int, float, float]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(cid).alias("cid"), F.lit(lon).alias("lon"), F.lit(lat).alias("lat"))
            for cid, lon, lat in chunk
        ]
    )


def _distance_array(cl: list[tuple[int, float, float]], lon: str | Column, lat: str | Column,
                    metric: str = "haversine") -> Column:
    values = ", ".join(f"named_struct('lon', {x!r}D, 'lat', {y!r}D)" for _, x, y in cl)
    return F.transform(F.expr(f"array({values})"), lambda c: METRICS[metric](lon, lat, c["lon"], c["lat"]))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nearest_dist(centers, lon: str | Column = "lon", lat: str | Column = "lat") -> Column:
    """Distance to the nearest centre: ``least`` over plain double distances."""
    cl = as_center_list(centers)
    if not cl:
        raise ValueError("no centres")
    if len(cl) > UNROLLED_CENTERS:
        return F.array_min(_distance_array(cl, lon, lat))
    terms = [haversine(lon, lat, clon, clat) for _, clon, clat in cl]
    return terms[0] if len(terms) == 1 else F.least(*terms)


def with_nearest(df: DataFrame, centers, lon: str = "lon", lat: str = "lat",
                 cluster: str = "cluster", dist: str = "dist", metric: str = "haversine") -> DataFrame:
    """Add ``cluster`` (nearest centre id) and ``dist`` (metres; squared degrees for
    ``metric="planar"``) to every row.

    One distance column per centre, ``least`` over them, and the first centre whose
    distance equals the minimum (ties go to the lower index, like a strict ``<`` scan).
    Distances are plain doubles (struct comparisons cost about twice as much); the
    per-centre columns are referenced twice, so Catalyst keeps them in their own
    projection and each is computed once, all inside one codegen stage.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    cl = as_center_list(centers)
    if not cl:
        raise ValueError("no centres")
    if len(cl) > UNROLLED_CENTERS:
        ids = F.expr(f"array({', '.join(str(cid) for cid, _, _ in cl)})")
        out = df.select("*", _distance_array(cl, lon, lat, metric).alias("__d")).withColumn(dist, F.array_min("__d"))
        first = F.array_position(F.col("__d"), F.col(dist)).cast("int")
        return out.withColumn(cluster, F.get(ids, first - 1).cast("int")).drop("__d")
    names = [f"__d{i}" for i in range(len(cl))]
    out = df.select("*", *[METRICS[metric](lon, lat, clon, clat).alias(n) for n, (_, clon, clat) in zip(names, cl)])
    m = F.col(names[0]) if len(names) == 1 else F.least(*[F.col(n) for n in names])
    out = out.withColumn(dist, m)
    pick = None
    for n, (cid, _, _) in zip(names, cl):
        cond = F.col(n) == F.col(dist)
        pick = F.when(cond, F.lit(cid)) if pick is None else pick.when(cond, F.lit(cid))
    return out.withColumn(cluster, pick.cast("int")).drop(*names)


def _many(centers) -> bool:
    """Whether a centres table is better met through an index than as literals: the answer
    is the same, but the literals' work per row grows with their number."""
    return (
        isinstance(centers, DataFrame)
        and "center_id" in centers.columns
        and centers.limit(INDEXED_CENTERS + 1).count() > INDEXED_CENTERS
    )


def assign_nearest(df: DataFrame, centers, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Every row plus ``cluster`` (nearest centre id) and ``dist`` (metres). Centres are a
    list or a table ``(center_id, lon, lat)`` of any size."""
    if _many(centers):
        from medoidlab.operators.center_index import assign_indexed

        out = assign_indexed(df.withColumns({"lon": F.col(lon), "lat": F.col(lat)}), centers)
        return out.select(*df.columns, "cluster", "dist")
    return with_nearest(df, centers, lon, lat)


def distances_to_centers(df: DataFrame, centers, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """P6 over a centre list: one row per (point, centre) with the distance.

    The centre list is a literal array of k structs, so the k-fold expansion happens
    inside the scan stage (a generator), with no join and no shuffle.
    """
    cl = as_center_list(centers)
    arr = _center_array(cl)
    exploded = df.select("*", F.explode(arr).alias("__c"))
    return exploded.select(
        *[c for c in df.columns],
        F.col("__c.cid").alias("center_id"),
        haversine(lon, lat, "__c.lon", "__c.lat").alias("dist"),
    )


def objective(df: DataFrame, centers) -> DataFrame:
    """A1: one-row DataFrame ``phi`` = sum of distances to the nearest centre."""
    if _many(centers):
        return assign_nearest(df.select("lon", "lat"), centers).agg(F.sum("dist").alias("phi"))
    return df.agg(F.sum(nearest_dist(centers)).alias("phi"))


def objective_value(df: DataFrame, centers) -> float:
    """A1 as a number."""
    v = objective(df, centers).collect()[0][0]
    return float(v) if v is not None else 0.0


def _sets_rows(rows) -> dict[int, list[tuple[int, float, float]]]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(int(r[0]), []).append((int(r[1]), float(r[2]), float(r[3])))
    return {s: sorted(v) for s, v in sorted(out.items())}


def _sets_batches(sets: DataFrame, max_centers: int):
    """The centre sets, whole, in batches of bounded size: the driver holds one at a time."""
    cols = sets.select("set_id", "center_id", "lon", "lat")
    rows = cols.limit(max_centers + 1).collect()
    if len(rows) <= max_centers:
        yield _sets_rows(rows)
        return
    kept = cut_lineage(cols)
    batches = -(-2 * kept.count() // max_centers)
    batch = F.pmod(F.xxhash64("set_id"), F.lit(batches))
    for b in range(batches):
        rows = kept.where(batch == b).collect()
        if rows:
            yield _sets_rows(rows)


def _dbl(x) -> str:
    """Exact double literal text (repr round-trips a Python float)."""
    return "CAST(NULL AS DOUBLE)" if x is None else f"{float(x)!r}D"


def _sets_array(sd: dict[int, list[tuple[int, float, float]]], ids: list[int], kmax: int) -> Column:
    """One flat struct per set: set_id, lon0, lat0, ..., padded with nulls to kmax.

    Written as one SQL expression so the literal is built by a single parse on the JVM
    instead of thousands of Python-to-JVM calls.
    """
    def one(s):
        cs = sd[s]
        fields = [f"'set_id', {int(s)}"]
        for i in range(kmax):
            lon, lat = (cs[i][1], cs[i][2]) if i < len(cs) else (None, None)
            fields.append(f"'lon{i}', {_dbl(lon)}, 'lat{i}', {_dbl(lat)}")
        return f"named_struct({', '.join(fields)})"

    return F.expr(f"array({', '.join(one(s) for s in ids)})")


def _set_nearest(kmax: int, lon: str, lat: str) -> Column:
    """Nearest distance to the centres of the exploded set ``__s`` (nulls are skipped)."""
    terms = [haversine(lon, lat, f"__s.lon{i}", f"__s.lat{i}") for i in range(kmax)]
    return terms[0] if kmax == 1 else F.least(*terms)


def objective_many(df: DataFrame, sets, lon: str = "lon", lat: str = "lat",
                   max_centers: int = MAX_LITERAL_CENTERS) -> DataFrame:
    """A2: ``(set_id, phi)`` for many centre sets, scored in one pass per batch of sets.

    ``sets`` is a DataFrame ``(set_id, center_id, lon, lat)`` or a mapping
    ``set_id -> centres``. A batch travels as one literal array of flat structs; every
    row is expanded to one row per set *inside the scan stage* (a generator, nothing is
    shuffled), the nearest distance is unrolled over the k centre fields of that set,
    and the sum is aggregated partially before the only shuffle (one row per set and
    partition). Expression size depends on k, not on the number of sets. A table of more
    than ``max_centers`` centres is read in batches, each scored and checkpointed (one row
    per set) before the next is fetched, so there is no largest number of sets.
    """
    if isinstance(sets, DataFrame):
        parts, last = [], None
        for sd in _sets_batches(sets, max_centers):
            if last is not None:
                parts.append(cut_lineage(_score_sets(df, last, lon, lat)))
            last = sd
        out = _score_sets(df, last, lon, lat)
        for p in parts:
            out = out.unionByName(p)
        return out
    return _score_sets(df, {int(s): as_center_list(c) for s, c in dict(sets).items()}, lon, lat)


def _score_sets(df: DataFrame, sd: dict[int, list[tuple[int, float, float]]], lon: str, lat: str) -> DataFrame:
    ids = sorted(sd)
    if not ids:
        raise ValueError("no centre sets")
    kmax = max(len(v) for v in sd.values())
    lon_c, lat_c = F.col(lon), F.col(lat)
    pieces = []
    for i in range(0, len(ids), SETS_PER_PASS):
        batch = ids[i : i + SETS_PER_PASS]
        rows = df.select(
            lon_c.alias("__lon"), lat_c.alias("__lat"), F.explode(_sets_array(sd, batch, kmax)).alias("__s")
        )
        d = _set_nearest(kmax, "__lon", "__lat")
        pieces.append(
            rows.select(F.col("__s.set_id").alias("set_id"), d.alias("d"))
            .groupBy("set_id")
            .agg(F.sum("d").alias("phi"))
            .select(F.col("set_id").cast("int").alias("set_id"), "phi")
        )
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def best_set(phis: DataFrame) -> DataFrame:
    """A10: the set with the lowest phi; ties go to the lower set id."""
    m = phis.agg(F.min(F.struct("phi", "set_id")).alias("m"))
    return m.select(F.col("m.set_id").alias("set_id"), F.col("m.phi").alias("phi"))


def clara_select(df: DataFrame, sets) -> DataFrame:
    """C11: score every set on the whole data and keep the argmin (set_id, phi)."""
    return best_set(objective_many(df, sets))


def cluster_summary(df: DataFrame, centers) -> DataFrame:
    """Per cluster: point count, sum and max distance to the centre."""
    a = assign_nearest(df, centers)
    return a.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("dist").alias("sum_dist"),
        F.max("dist").alias("max_dist"),
    )
