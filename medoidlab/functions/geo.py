"""Column expressions: distance, identity, hashing, pixels and colours.

Everything here is a plain ``Column`` built from ``pyspark.sql.functions`` so it stays
inside whole-stage codegen. The SQL twins in :mod:`medoidlab.functions.sqltext` spell
the same arithmetic in the same order, which keeps Spark and DuckDB results equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medoidlab.schema import EARTH_RADIUS_M, IMAGE_BOX, IMAGE_SIZE, Box


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def sql_ref(x) -> str | None:
    """SQL text of a column name (``a`` or ``a.b``) or a number (double literal)."""
    if isinstance(x, bool):
        return None
    if isinstance(x, str):
        return ".".join(f"`{part}`" for part in x.split("."))
    if isinstance(x, (int, float)):
        return f"{float(x)!r}D"
    return None


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = EARTH_RADIUS_M) -> str:
    """Spark SQL text of the haversine formula (same operation order as below)."""
    dlat = f"radians({lat2} - {lat1})"
    dlon = f"radians({lon2} - {lon1})"
    a = f"(sin({dlat} / 2) * sin({dlat} / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin({dlon} / 2) * sin({dlon} / 2))"
    return f"({float(radius)!r}D * (2.0D * atan2(sqrt({a}), sqrt(1.0D - {a}))))"


def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres; exactly 0 for equal points.

    Arguments are column names, numbers or Columns. Names and numbers become a single
    SQL expression (one call into the JVM instead of one per arithmetic step).
    """
    refs = [sql_ref(x) for x in (lon1, lat1, lon2, lat2)]
    if all(r is not None for r in refs):
        return F.expr(haversine_sql(*refs, radius=radius))
    lon1, lat1, lon2, lat2 = _c(lon1), _c(lat1), _c(lon2), _c(lat2)
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        dlon / 2
    ) * F.sin(dlon / 2)
    return F.lit(radius) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))


def same_place(lon1, lat1, lon2, lat2) -> Column:
    """Two positions are the same place when both coordinates are equal (id ignored)."""
    return (_c(lon1) == _c(lon2)) & (_c(lat1) == _c(lat2))


def hash32(value, salt: str) -> Column:
    """Repeatable unsigned 32-bit hash of ``value`` and a salt (md5 based).

    The same number comes out of DuckDB's ``md5``, so seeded sampling and bucketing
    are oracle-comparable.
    """
    text = F.concat(_c(value).cast("string"), F.lit(salt))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def hash_unit(value, salt: str) -> Column:
    """``hash32`` mapped onto [0, 1)."""
    return hash32(value, salt) / F.lit(4294967296.0)


def salt(seed: int, purpose: str) -> str:
    """Salt text for one use of randomness; different purposes stay independent."""
    return f"#{int(seed)}:{purpose}"


def to_pixel_x(lon, box: Box = IMAGE_BOX, width: int = IMAGE_SIZE) -> Column:
    """Pixel column, rounded half up like ``Math.round`` (``floor(e + 0.5)``)."""
    e = (_c(lon) - F.lit(box.min_lon)) / F.lit(box.max_lon - box.min_lon) * F.lit(float(width))
    return F.floor(e + F.lit(0.5)).cast("int")


def to_pixel_y(lat, box: Box = IMAGE_BOX, height: int = IMAGE_SIZE) -> Column:
    """Pixel row, counted down from the top (max latitude)."""
    e = (F.lit(box.max_lat) - _c(lat)) / F.lit(box.max_lat - box.min_lat) * F.lit(float(height))
    return F.floor(e + F.lit(0.5)).cast("int")


def color_cube_side(k: int) -> int:
    """Side of the RGB cube walked for k clusters: the ceiling of cbrt(k + 1)."""
    root = round((k + 1) ** (1.0 / 3.0))
    if root**3 == k + 1:
        return int(root)
    side = int((k + 1) ** (1.0 / 3.0))
    while side**3 < k + 1:
        side += 1
    return side


def cluster_color(cluster, k: int) -> tuple[Column, Column, Column]:
    """(r, g, b) integer columns of a cluster's colour for a k-cluster picture.

    Colour position ``(cluster + 1) * step`` is read as a base-``side`` number with
    fractional digits kept; a side of 1 (no model) is white.
    """
    side = color_cube_side(k)
    if side == 1:
        return F.lit(255), F.lit(255), F.lit(255)
    step = (side**3) // (k + 1)
    pos = ((_c(cluster) + F.lit(1)) * F.lit(step)).cast("double")
    s = F.lit(float(side))
    r = F.floor((pos % s) / s * F.lit(255.0)).cast("int")
    g = F.floor(((pos / s) % s) / s * F.lit(255.0)).cast("int")
    b = F.floor(((pos / s / s) % s) / s * F.lit(255.0)).cast("int")
    return r, g, b
