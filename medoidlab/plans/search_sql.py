"""DuckDB twins of the registered searches: sampling, rounds, merge or selection, phi."""

from __future__ import annotations

from medoidlab.functions import searchsql as R
from medoidlab.functions import sqltext as Q
from medoidlab.functions.geo import salt

_N = "(SELECT count(*) FROM positions)"


def recursive(body: str, *ctes: str) -> str:
    return Q.with_positions(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def full(k: int, seed: int) -> tuple[str, str]:
    """(keyed CTE, planned bucket count) of all rows in floor(sqrt(n/k)) buckets."""
    count = f"(SELECT greatest(1, CAST(floor(sqrt(count(*) // {k})) AS BIGINT)) FROM positions)"
    return (
        f"keyed AS (SELECT id, lon, lat, CAST({Q.hash32('id', salt(seed, 'bucket'))} % {count} AS INTEGER) AS bucket FROM positions)",
        count,
    )


def reduced(buckets: int, seed: int) -> tuple[str, str]:
    """The same for a sample at rate l / sqrt(n) in l buckets."""
    return (
        f"""keyed AS (SELECT id, lon, lat, CAST({Q.hash32('id', salt(seed, 'bucket'))} % {buckets} AS INTEGER) AS bucket
  FROM positions WHERE {Q.hash_unit('id', salt(seed, 'keep'))} < least(1.0, {buckets} / sqrt({_N})))""",
        str(buckets),
    )


def drawn(rows: int, buckets: int, seed: int) -> str:
    """An exact sample without replacement, dealt round robin."""
    return f"""keyed AS (SELECT id, lon, lat, CAST((rn - 1) % {buckets} AS INTEGER) AS bucket FROM (
  SELECT id, lon, lat, row_number() OVER (ORDER BY {Q.hash32('id', salt(seed, 'order'))}, id) AS rn FROM positions)
  WHERE rn <= {rows})"""


def drawn_again(size: int, buckets: int, seed: int) -> str:
    """An exact sample with replacement, dealt round robin."""
    text = f"concat(cast(range as varchar), '{salt(seed, 'draw')}')"
    return f"""keyed AS (
  SELECT i.id, i.lon, i.lat, CAST(d.draw % {buckets} AS INTEGER) AS bucket
  FROM (SELECT range AS draw, cast('0x' || substr(md5({text}), 1, 15) as bigint) % {_N} AS idx FROM range({size * buckets})) d
  JOIN (SELECT id, lon, lat, row_number() OVER (ORDER BY {Q.hash32('id', salt(seed, 'order'))}, id) - 1 AS idx
        FROM positions) i USING (idx))"""


_RESULT = """SELECT c.center_id, c.id, c.lon, c.lat, round(f.phi, 1) AS phi
FROM {centers}_centers c JOIN {scored}_phi f USING (bucket)"""


def pam_sql(keyed: str, k: int) -> str:
    """PAM per bucket, PAM again over the bucket centres."""
    return recursive(
        _RESULT.format(centers="m", scored="m"),
        keyed,
        R.places_cte("pl", "keyed"),
        *R.pam_ctes("b", "pl", k),
        R.merged_pool("pool", "b_centers"),
        *R.pam_ctes("m", "pool", k),
        *R.scored_ctes("m", "m_centers"),
    )


def clara_sql(keyed: str, k: int) -> str:
    """PAM per bucket, the set with the lowest phi on all rows."""
    best = "\nWHERE bucket = (SELECT arg_min(bucket, (phi, bucket)) FROM b_phi)"
    return recursive(
        _RESULT.format(centers="b", scored="b") + best,
        keyed,
        R.places_cte("pl", "keyed"),
        *R.pam_ctes("b", "pl", k),
        *R.scored_ctes("b", "b_centers"),
    )


def clarans_sql(keyed: tuple[str, str], k: int, nlocal: int, seed: int) -> str:
    """CLARANS per bucket, CLARANS again over the bucket centres."""
    draw = lambda s: Q.hash32("id", salt(s, "draw"))
    return recursive(
        _RESULT.format(centers="m", scored="m"),
        keyed[0],
        R.places_cte("pl", "keyed"),
        *R.clarans_ctes("b", "pl", k, nlocal, seed, keyed[1], draw(seed)),
        R.merged_pool("pool", "b_centers"),
        *R.clarans_ctes("m", "pool", k, nlocal, seed + 1, "1", draw(seed + 1)),
        *R.scored_ctes("m", "m_centers"),
    )


def sweep_ctes(ks: list[int], buckets: int, seed: int) -> list[str]:
    """Reduced CLARA for several k: ``runs (k, center_id, lon, lat, phi)``."""
    ctes, runs = [reduced(buckets, seed)[0], R.places_cte("pl", "keyed")], []
    for k in ks:
        ctes += [*R.pam_ctes(f"k{k}", "pl", k), *R.scored_ctes(f"k{k}", f"k{k}_centers")]
        runs.append(
            f"SELECT CAST({k} AS INTEGER) AS k, center_id, lon, lat, phi FROM k{k}_centers JOIN k{k}_phi USING (bucket) "
            f"WHERE bucket = (SELECT arg_min(bucket, (phi, bucket)) FROM k{k}_phi)"
        )
    return [*ctes, f"runs AS MATERIALIZED ({' UNION ALL '.join(runs)})"]


def sweep_sql(ks: list[int], buckets: int, seed: int) -> str:
    """phi and number of centres of every run."""
    parts = []
    for k in ks:
        parts.append(
            f"SELECT CAST({k} AS INTEGER) AS k, 'CLARA' AS algorithm, round(min(phi), 1) AS phi, "
            f"CAST(count(*) AS INTEGER) AS n_centers FROM runs WHERE k = {k}"
        )
    skipped = f"""SELECT CAST(k AS INTEGER), algorithm, NULL, NULL::integer
FROM (SELECT unnest({ks}) AS k), (VALUES ('PAM'), ('CLARAFAST'), ('CLARANS'), ('KMEANS')) t(algorithm)"""
    return recursive("\nUNION ALL ".join([*parts, skipped]), *sweep_ctes(ks, buckets, seed))


def _colors(ks: list[int], color) -> str:
    """r, g, b of column ``cluster`` by column ``k``; ``color(cluster, k)`` gives SQL."""
    parts = []
    for i, name in enumerate("rgb"):
        cases = " ".join(f"WHEN {k} THEN {color('cluster', k)[i]}" for k in ks)
        parts.append(f"CASE k {cases} END AS {name}")
    return ", ".join(parts)


def sweep_pixels_sql(ks: list[int], buckets: int, seed: int, inside: str, color) -> str:
    """The drawn pixels of every run of the sweep."""
    d = Q.haversine("p.lon", "p.lat", "c.lon", "c.lat")
    return recursive(
        f"""SELECT k, 'CLARA' AS algorithm, x, y, cluster, CAST(count(*) AS BIGINT) AS n, {_colors(ks, color)}
FROM (SELECT c.k, p.id, p.x, p.y, arg_min(c.center_id, ({d}, c.center_id)) AS cluster
      FROM (SELECT id, lon, lat, {Q.pixel_x('lon')} AS x, {Q.pixel_y('lat')} AS y FROM positions) p CROSS JOIN runs c
      WHERE {inside} GROUP BY c.k, p.id, p.x, p.y)
GROUP BY k, x, y, cluster""",
        *sweep_ctes(ks, buckets, seed),
    )


def sweep_centers_sql(ks: list[int], buckets: int, seed: int, inside: str) -> str:
    """The centre squares of every run of the sweep."""
    return recursive(
        f"""SELECT k, 'CLARA' AS algorithm, center_id, xc, yc, CAST(sum(CASE WHEN {inside} THEN 1 ELSE 0 END) AS BIGINT) AS drawn,
       CAST(sum(CASE WHEN {inside} THEN 0 ELSE 1 END) AS BIGINT) AS dropped,
       CASE WHEN bool_and({inside}) THEN 'inside' WHEN bool_or({inside}) THEN 'cut' ELSE 'outside' END AS status
FROM (SELECT k, center_id, xc, yc, xc - 5 + dx AS x, yc - 5 + dy AS y
      FROM (SELECT k, center_id, {Q.pixel_x('lon')} AS xc, {Q.pixel_y('lat')} AS yc FROM runs),
           (SELECT range AS dx FROM range(10)), (SELECT range AS dy FROM range(10)))
GROUP BY k, center_id, xc, yc""",
        *sweep_ctes(ks, buckets, seed),
    )


def wide_sql(ks: list[int], buckets: int, seed: int, bits: dict[int, str], max_k: int) -> str:
    """The wide results rows without their time; places as rounded text."""
    place = lambda c, i: (
        f"coalesce(printf('%.6f', max(CASE WHEN center_id = {i} THEN {c} END)), 'NULL') AS {c}_{i}"
    )
    columns = ", ".join(place(c, i) for i in range(max_k) for c in ("lat", "lon"))
    names = ", ".join(f"('{bit}', '{name}')" for bit, name in bits.items())
    return recursive(
        f"""SELECT k.k::varchar AS k, bit AS algorithm, coalesce(printf('%.1f', max(phi)), 'NULL') AS phi, {columns}
FROM (SELECT unnest({ks}) AS k) k CROSS JOIN (VALUES {names}) t(bit, name)
LEFT JOIN runs ON runs.k = k.k AND name = 'CLARA' GROUP BY k.k, bit""",
        *sweep_ctes(ks, buckets, seed),
    )


_SQUARE, _DEGREE = "1e12::double", "1e9::double"


def _planar(a: str, b: str) -> str:
    return f"(({a}.lon - {b}.lon) * ({a}.lon - {b}.lon) + ({a}.lat - {b}.lat) * ({a}.lat - {b}.lat))"


def _units(value: str, units: str) -> str:
    return f"CAST(floor({value} * {units} + 0.5::double) AS BIGINT)"


def kmeans_ctes(k: int, seed: int, steps: int, oversample: float, tolerance: float, rounds: int) -> list[str]:
    """k-means||: ``model (center_id, lon, lat)``."""
    unit = lambda text: f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0::double)"
    ctes = [
        f"""chosen0 AS MATERIALIZED (SELECT id, lon, lat FROM positions ORDER BY {Q.hash32('id', salt(seed, 'first'))}, id, lon, lat LIMIT 1)"""
    ]
    for i in range(steps):
        ctes += [
            f"""scored{i} AS MATERIALIZED (SELECT p.id, p.lon, p.lat, {_units(f"min({_planar('p', 'c')})", _SQUARE)} AS units
  FROM positions p CROSS JOIN chosen{i} c GROUP BY p.id, p.lon, p.lat)""",
            f"""chosen{i + 1} AS MATERIALIZED (SELECT * FROM chosen{i} UNION SELECT id, lon, lat FROM scored{i}
  WHERE {unit(f"concat(id::varchar, '{salt(seed, f'step{i}')}')")}
        < {float(oversample * k)!r}::double * units::double / (SELECT sum(units) FROM scored{i})::double)""",
        ]
    last = f"chosen{steps}"
    pick = unit("concat(len(picked)::varchar, '" + salt(seed, "pick") + "')")
    return [
        *ctes,
        f"cand AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id, lon, lat) - 1 AS i, lon, lat FROM {last})",
        f"""weighted AS MATERIALIZED (SELECT i, cand.lon, cand.lat, count(own) AS weight FROM cand LEFT JOIN (
    SELECT p.id, arg_min(c.i, ({_planar('p', 'c')}, c.i)) AS own FROM positions p CROSS JOIN cand c GROUP BY p.id) ON own = i
  GROUP BY ALL)""",
        f"""draws AS (
  SELECT []::bigint[] AS picked
  UNION ALL
  SELECT list_append(picked, arg_min(i, i)) FROM (
    SELECT picked, i, sum(score) OVER (ORDER BY i) AS running,
           floor({pick} * (sum(score) OVER ())::double)::hugeint AS target, sum(score) OVER () AS total
    FROM (SELECT picked, w.i, w.weight::hugeint * CASE WHEN len(picked) = 0 THEN 1 ELSE
            (SELECT min({_units(_planar('w', 'o'), _SQUARE)}) FROM weighted o WHERE list_contains(draws.picked, o.i)) END AS score
          FROM draws CROSS JOIN weighted w WHERE len(picked) < {k}))
  WHERE total > 0 AND running > target GROUP BY picked)""",
        """seeds AS (SELECT list(struct_pack(c := place, lon := lon, lat := lat) ORDER BY place) AS cs FROM (
    SELECT unnest(picked) AS i, unnest(range(len(picked))) AS place FROM (SELECT picked FROM draws ORDER BY len(picked) DESC LIMIT 1))
  JOIN cand USING (i))""",
        f"""lloyd AS (
  SELECT 0 AS round, cs, 'inf'::double AS moved FROM seeds
  UNION ALL
  SELECT round + 1, list(struct_pack(c := c, lon := lon, lat := lat) ORDER BY c),
         max((lon - old_lon) * (lon - old_lon) + (lat - old_lat) * (lat - old_lat))
  FROM (
    SELECT any_value(round) AS round, o.c, any_value(o.lon) AS old_lon, any_value(o.lat) AS old_lat,
           coalesce(sum({_units('a.lon', _DEGREE)})::double / count(a.lon) / {_DEGREE}, any_value(o.lon)) AS lon,
           coalesce(sum({_units('a.lat', _DEGREE)})::double / count(a.lat) / {_DEGREE}, any_value(o.lat)) AS lat
    FROM (SELECT round, unnest(cs, recursive := true) FROM lloyd WHERE round < {rounds} AND moved > {tolerance * tolerance!r}) o
    LEFT JOIN (SELECT p.id, any_value(p.lon) AS lon, any_value(p.lat) AS lat, arg_min(c.c, ({_planar('p', 'c')}, c.c)) AS c
               FROM positions p CROSS JOIN (SELECT unnest(cs, recursive := true) FROM lloyd) c GROUP BY p.id) a ON a.c = o.c
    GROUP BY o.c)
  GROUP BY ALL HAVING count(*) > 0)""",
        """model AS MATERIALIZED (SELECT c::integer AS center_id, lon, lat FROM (
    SELECT unnest(cs, recursive := true) FROM (SELECT cs FROM lloyd ORDER BY round DESC LIMIT 1)))""",
        f"""predicted AS MATERIALIZED (SELECT p.id, any_value(p.lon) AS lon, any_value(p.lat) AS lat,
    arg_min(c.center_id, ({_planar('p', 'c')}, c.center_id)) AS cluster FROM positions p CROSS JOIN model c GROUP BY p.id)""",
    ]


def kmeans_sql(ctes: list[str]) -> str:
    d = Q.haversine("p.lon", "p.lat", "c.lon", "c.lat")
    return recursive(
        f"""SELECT center_id, round(lon, 9) AS lon, round(lat, 9) AS lat, round((SELECT sum(d) FROM (
    SELECT p.id, min({d}) AS d FROM positions p CROSS JOIN model c GROUP BY p.id)), 1) AS phi FROM model""",
        *ctes,
    )


def kmeans_radius_sql(ctes: list[str]) -> str:
    d = Q.haversine("p.lon", "p.lat", "c.lon", "c.lat")
    return recursive(
        f"""SELECT round(avg(r), 3) AS mean_radius, round(stddev_samp(r), 3) AS std_radius, CAST(count(*) AS BIGINT) AS clusters
FROM (SELECT cluster, max({d}) AS r FROM predicted p JOIN model c ON c.center_id = p.cluster GROUP BY cluster)""",
        *ctes,
    )


def kmeans_raster_sql(ctes: list[str], k: int, inside: str, color) -> str:
    r, g, b = color("cluster", k)
    return recursive(
        f"""SELECT x, y, cluster, CAST(count(*) AS BIGINT) AS n, {r} AS r, {g} AS g, {b} AS b
FROM (SELECT cluster, {Q.pixel_x('lon')} AS x, {Q.pixel_y('lat')} AS y FROM predicted) WHERE {inside} GROUP BY x, y, cluster""",
        *ctes,
    )
