"""ANSI SQL (DuckDB dialect) twins of the column expressions, for oracle checks.

Each helper returns SQL text computing the same value, in the same operation order,
as its ``Column`` counterpart in :mod:`medoidlab.functions.geo`.
"""

from __future__ import annotations

from medoidlab.schema import CLEAN_BOX, EARTH_RADIUS_M, IMAGE_BOX, IMAGE_SIZE, Box


def hash32(expr: str, salt: str) -> str:
    return f"cast('0x' || substr(md5(concat(cast({expr} as varchar), '{salt}')), 1, 8) as bigint)"


def hash_unit(expr: str, salt: str) -> str:
    return f"({hash32(expr, salt)} / 4294967296.0)"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = EARTH_RADIUS_M) -> str:
    dlat = f"radians(({lat2}) - ({lat1}))"
    dlon = f"radians(({lon2}) - ({lon1}))"
    a = (
        f"(sin({dlat} / 2) * sin({dlat} / 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * sin({dlon} / 2) * sin({dlon} / 2))"
    )
    return f"({radius!r} * (2.0 * atan2(sqrt({a}), sqrt(1.0 - {a}))))"


def lit(x: float) -> str:
    return repr(float(x))


def nearest_case(lon: str, lat: str, centers) -> tuple[str, str]:
    """(distance, index) SQL of the nearest centre, ties to the lower index."""
    terms = [
        f"struct_pack(d := {haversine(lon, lat, lit(c[0]), lit(c[1]))}, c := {i})" for i, c in enumerate(centers)
    ]
    s = terms[0] if len(terms) == 1 else f"least({', '.join(terms)})"
    return f"({s}).d", f"cast(({s}).c as integer)"


def trips_cte() -> str:
    h = lambda s: hash32("o_orderkey", s)
    return f"""trips AS (
  SELECT cast(o_orderkey AS varchar) AS TRIP_ID,
         CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS CALL_TYPE,
         CASE WHEN {h('p')} % 20 = 0 THEN '[]'
              ELSE '[[-8.' || lpad(cast(380000 + {h('x')} % 340000 AS varchar), 6, '0') || ','
                   || CASE WHEN {h('q')} % 25 = 0 THEN '40.' ELSE '41.' END
                   || lpad(cast({h('y')} % 350000 AS varchar), 6, '0') || '],[-8.600000,41.150000]]'
         END AS POLYLINE
  FROM orders)"""


def pickup_cte(source: str = "trips") -> str:
    first = "split_part(POLYLINE, ']', 1)"
    return f"""pickups AS (
  SELECT try_cast(TRIP_ID AS bigint) AS id,
         try_cast(trim(substr(split_part({first}, ',', 1), 3)) AS double) AS lon,
         try_cast(trim(split_part({first}, ',', 2)) AS double) AS lat
  FROM {source}
  WHERE contains(CALL_TYPE, 'C') AND length(POLYLINE) > 5)"""


def bbox(lon: str, lat: str, box: Box = CLEAN_BOX) -> str:
    return (
        f"{lat} > {lit(box.min_lat)} AND {lat} < {lit(box.max_lat)} AND "
        f"{lon} > {lit(box.min_lon)} AND {lon} < {lit(box.max_lon)}"
    )


def positions_cte() -> str:
    return f"""{trips_cte()},
{pickup_cte()},
positions AS (
  SELECT id, lon, lat FROM pickups WHERE id IS NOT NULL AND {bbox('lon', 'lat')})"""


def with_positions(body: str, *ctes: str) -> str:
    """``WITH trips, pickups, positions[, extra ctes] body``."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {positions_cte()}{extra}\n{body}"


def pixel_x(lon: str, box: Box = IMAGE_BOX, width: int = IMAGE_SIZE) -> str:
    return f"cast(floor(({lon} - {lit(box.min_lon)}) / {lit(box.max_lon - box.min_lon)} * {lit(width)} + 0.5) AS integer)"


def pixel_y(lat: str, box: Box = IMAGE_BOX, height: int = IMAGE_SIZE) -> str:
    return f"cast(floor(({lit(box.max_lat)} - {lat}) / {lit(box.max_lat - box.min_lat)} * {lit(height)} + 0.5) AS integer)"
