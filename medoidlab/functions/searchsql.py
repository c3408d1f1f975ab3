"""DuckDB twins of the k-medoid searches: recursive queries whose rows are the rounds.

Each function returns the CTEs of one stage. ``source`` names a CTE of places
``(bucket, id, lon, lat, w)``; ``<name>_walk`` then holds one row per bucket and round
with the medoid ids, so the walk is also the search's trace.
"""

from __future__ import annotations

from medoidlab.functions.sqltext import haversine

IMPROVES = "1e-6"
DRAW_PRIME = 2147483647


def places_cte(name: str, source: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT bucket, lon, lat, CAST(count(*) AS BIGINT) AS w, min(id) AS id "
        f"FROM {source} GROUP BY bucket, lon, lat)"
    )


def distances_cte(name: str, source: str) -> str:
    """Distances between all places of a bucket: place ``p`` (weight w) and place ``c``."""
    d = haversine("a.lon", "a.lat", "b.lon", "b.lat")
    return (
        f"{name}_dist AS MATERIALIZED (SELECT a.bucket, a.id AS p, a.w, b.id AS c, {d} AS d "
        f"FROM {source} a JOIN {source} b USING (bucket))"
    )


def _nearest(state: str, name: str, keys: str) -> str:
    """CTEs s, nn: each place's two nearest medoids for every row of ``state``."""
    return f"""s AS (SELECT {keys}, med, unnest(med) AS m, unnest(range(len(med))) AS slot FROM {state}),
    nn AS (SELECT {', '.join(f's.{x.strip()}' for x in keys.split(','))}, p, any_value(w) AS w, min(d) AS d1,
             arg_min(slot, (d, slot)) AS near, coalesce(list_sort(list(d))[2], 'inf'::double) AS d2
           FROM s JOIN {name}_dist x ON x.bucket = s.bucket AND x.c = s.m GROUP BY ALL)"""


def pam_ctes(name: str, source: str, k: int) -> list[str]:
    """Steepest swaps from the first k places in id order, per bucket. ``_walk`` has
    ``(bucket, round, med, phi, cand_id, slot)``, ``_final`` the last round of each bucket."""
    return [
        distances_cte(name, source),
        f"""{name}_walk AS (
  SELECT bucket, 0 AS round, med, phi, NULL::bigint AS cand_id, NULL::bigint AS slot FROM (
    WITH first AS (SELECT bucket, list(id ORDER BY id)[1:{k}] AS med FROM {source} GROUP BY bucket HAVING count(*) >= {k}),
    {_nearest('first', name, 'bucket')}
    SELECT bucket, med, sum(w * d1) AS phi FROM nn JOIN first USING (bucket) GROUP BY bucket, med)
  UNION ALL
  SELECT bucket, round + 1, list_transform(med, lambda m, i: CASE WHEN i = best.slot + 1 THEN best.c ELSE m END),
         best.phi, best.c, best.slot
  FROM (
    WITH cur AS (SELECT * FROM {name}_walk),
    {_nearest('cur', name, 'bucket')},
    part AS (SELECT n.bucket, x.c, near, sum(n.w * least(x.d, d1)) AS kept, sum(n.w * least(x.d, d2)) AS lost
             FROM nn n JOIN {name}_dist x ON x.bucket = n.bucket AND x.p = n.p GROUP BY ALL),
    base AS (SELECT bucket, c, sum(kept) AS kept FROM part GROUP BY ALL),
    cost AS (SELECT part.bucket, c, near AS slot, base.kept - part.kept + part.lost AS phi FROM part JOIN base USING (bucket, c))
    SELECT cur.bucket, any_value(round) AS round, any_value(med) AS med, any_value(cur.phi) AS before,
           arg_min(struct_pack(phi := cost.phi, c := c, slot := cost.slot), (cost.phi, c, cost.slot)) AS best
    FROM cost JOIN cur USING (bucket) WHERE NOT list_contains(med, c) GROUP BY cur.bucket)
  WHERE best.phi < before - {IMPROVES})""",
        f"{name}_final AS (SELECT bucket, arg_max(med, round) AS med, max(round) AS rounds FROM {name}_walk GROUP BY bucket)",
        f"""{name}_centers AS (
  SELECT f.bucket, CAST(f.slot AS INTEGER) AS center_id, x.id, x.lon, x.lat
  FROM (SELECT bucket, unnest(med) AS id, unnest(range(len(med))) AS slot FROM {name}_final) f
  JOIN {source} x ON x.bucket = f.bucket AND x.id = f.id)""",
    ]


def merged_pool(name: str, centers: str) -> str:
    """The places of the merge: all bucket centres as one bucket."""
    return places_cte(name, f"(SELECT 0 AS bucket, id, lon, lat FROM {centers})")


def _params(seed: int, round_sql: str) -> str:
    """Multipliers and offsets of a round's two hash orders (see ``kernels.draw_params``)."""
    text = f"concat('{seed}|', bucket::varchar, '|', start::varchar, '|', ({round_sql})::varchar)"
    hex_part = lambda i: f"('0x' || substr(md5({text}), {8 * i + 1}, 8))::bigint"
    p = DRAW_PRIME
    return (
        f"1 + {hex_part(0)} % {p - 1} AS a1, {hex_part(1)} % {p} AS b1, "
        f"1 + {hex_part(2)} % {p - 1} AS a2, {hex_part(3)} % {p} AS b2"
    )


def clarans_ctes(name: str, source: str, k: int, nlocal: int, seed: int, buckets: str, draw: str) -> list[str]:
    """C16-C21 per bucket. ``buckets`` is the SQL of the planned bucket count and ``draw``
    the SQL of a place's draw value (its column ``id``)."""
    p = DRAW_PRIME
    size = f"(SELECT count(*) FROM {source}) // {buckets}"
    budget = f"greatest(1, ({k} * (({size}) - {k})) // 100, (8 * ({size})) // 100)"
    return [
        f"{name}_src AS MATERIALIZED (SELECT *, {draw} % {p} AS h, count(*) OVER (PARTITION BY bucket) AS u FROM {source})",
        distances_cte(name, source),
        f"{name}_budget AS MATERIALIZED (SELECT {budget} AS nneighbor)",
        f"""{name}_walk AS (
  SELECT bucket, start, 0 AS round, med, phi FROM (
    WITH par AS (SELECT bucket, start, {_params(seed, '0')}
                 FROM (SELECT DISTINCT bucket FROM {name}_src WHERE u >= {k}), (SELECT range AS start FROM range({nlocal}))),
    drawn AS (SELECT bucket, start, id, row_number() OVER (PARTITION BY bucket, start ORDER BY (a1 * h + b1) % {p}, id) AS nth
              FROM par JOIN {name}_src USING (bucket)),
    first AS (SELECT bucket, start, list(id ORDER BY id) AS med FROM drawn WHERE nth <= {k} GROUP BY ALL),
    {_nearest('first', name, 'bucket, start')}
    SELECT bucket, start, med, sum(w * d1) AS phi FROM nn JOIN first USING (bucket, start) GROUP BY bucket, start, med)
  UNION ALL
  SELECT bucket, start, round + 1, list_transform(med, lambda m, i: CASE WHEN i = best.slot + 1 THEN best.c ELSE m END), best.phi
  FROM (
    WITH cur AS (SELECT * FROM {name}_walk),
    par AS (SELECT bucket, start, med, {_params(seed, 'round + 1')} FROM cur),
    {_nearest('cur', name, 'bucket, start')},
    pairs AS (SELECT x.bucket, x.start, arg_min([x.slot, y.slot], (z.d, x.slot, y.slot)) AS pair
              FROM s x JOIN s y ON x.bucket = y.bucket AND x.start = y.start AND x.slot < y.slot
              JOIN {name}_dist z ON z.bucket = x.bucket AND z.p = x.m AND z.c = y.m GROUP BY x.bucket, x.start),
    drawn AS (SELECT bucket, start, id AS c, u, (a1 * h + b1) % {p} AS x, pair[1 + ((a2 * h + b2) % {p}) % 2] AS slot,
                     row_number() OVER (PARTITION BY bucket, start ORDER BY (a1 * h + b1) % {p}, id) AS nth
              FROM par JOIN {name}_src USING (bucket) JOIN pairs USING (bucket, start) WHERE NOT list_contains(med, id)),
    cost AS (SELECT t.bucket, t.start, t.c, t.x, t.slot,
                    sum(n.w * least(z.d, CASE WHEN near = t.slot THEN d2 ELSE d1 END)) AS phi
             FROM drawn t JOIN {name}_dist z ON z.bucket = t.bucket AND z.c = t.c
             JOIN nn n ON n.bucket = t.bucket AND n.start = t.start AND n.p = z.p
             WHERE nth <= greatest(1, least((SELECT nneighbor FROM {name}_budget), u - {k})) GROUP BY ALL)
    SELECT cur.bucket, cur.start, any_value(round) AS round, any_value(med) AS med, any_value(cur.phi) AS before,
           arg_min(struct_pack(phi := cost.phi, c := c, slot := cost.slot), (cost.phi, x, c)) AS best
    FROM cost JOIN cur USING (bucket, start) GROUP BY cur.bucket, cur.start)
  WHERE best.phi < before - {IMPROVES})""",
        f"""{name}_final AS (
  SELECT bucket, arg_min(list_sort(med), (phi, start)) AS med FROM (
    SELECT bucket, start, arg_max(med, round) AS med, arg_max(phi, round) AS phi FROM {name}_walk GROUP BY ALL)
  GROUP BY bucket)""",
        f"""{name}_centers AS (
  SELECT f.bucket, CAST(f.slot AS INTEGER) AS center_id, x.id, x.lon, x.lat
  FROM (SELECT bucket, unnest(med) AS id, unnest(range(len(med))) AS slot FROM {name}_final) f
  JOIN {source} x ON x.bucket = f.bucket AND x.id = f.id)""",
    ]


def scored_ctes(name: str, centers: str) -> list[str]:
    """phi on all positions of one centre set per bucket of ``centers``."""
    d = haversine("q.lon", "q.lat", "c.lon", "c.lat")
    return [
        f"""{name}_phi AS (SELECT bucket, sum(d) AS phi FROM (
    SELECT c.bucket, q.id, min({d}) AS d FROM positions q CROSS JOIN {centers} c GROUP BY c.bucket, q.id) GROUP BY bucket)"""
    ]
