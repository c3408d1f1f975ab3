"""Trip cleaning (P1-P5): call type, track presence, pickup point, id, box.

All of it is a single narrow plan: Catalyst keeps every predicate, pushes what it
can into the scan and prunes the raw columns to ``TRIP_ID, CALL_TYPE, POLYLINE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.schema import CLEAN_BOX, KEEP_CALL_TYPE, MIN_TRACK_CHARS, Box


def filter_call_type(df: DataFrame, call_type: str = KEEP_CALL_TYPE) -> DataFrame:
    """Keep trips whose CALL_TYPE contains ``call_type`` (null rows drop)."""
    return df.where(F.col("CALL_TYPE").contains(call_type))


def has_track(df: DataFrame, min_chars: int = MIN_TRACK_CHARS) -> DataFrame:
    """Keep trips whose POLYLINE text is longer than ``min_chars``."""
    return df.where(F.length("POLYLINE") > min_chars)


def _first_pair(polyline: Column) -> tuple[Column, Column]:
    # Text before the first ']', split on ','; the first part loses its two leading
    # characters ('[['), the second is the latitude. Bad or short text gives null.
    first = F.substring_index(polyline, "]", 1)
    parts = F.split(first, ",")
    lon_txt = F.substr(F.get(parts, 0), F.lit(3))
    lat_txt = F.get(parts, 1)
    return lon_txt, lat_txt


def pickup_point(df: DataFrame) -> DataFrame:
    """P3 + P5: (id, lon, lat) from the trip id and the first pair of the track.

    Rows whose id or coordinates do not parse come out with nulls; ``clean_trips``
    drops them.
    """
    lon_txt, lat_txt = _first_pair(F.col("POLYLINE"))
    return df.select(
        F.col("TRIP_ID").try_cast("bigint").alias("id"),
        F.trim(lon_txt).try_cast("double").alias("lon"),
        F.trim(lat_txt).try_cast("double").alias("lat"),
    )


def in_bbox_condition(lon, lat, box: Box = CLEAN_BOX) -> Column:
    """P4 predicate, strict on all four sides."""
    lon = F.col(lon) if isinstance(lon, str) else lon
    lat = F.col(lat) if isinstance(lat, str) else lat
    return (lat > box.min_lat) & (lat < box.max_lat) & (lon > box.min_lon) & (lon < box.max_lon)


def in_bbox(df: DataFrame, box: Box = CLEAN_BOX) -> DataFrame:
    """Keep positions strictly inside ``box``."""
    return df.where(in_bbox_condition("lon", "lat", box))


def clean_trips(trips: DataFrame, call_type: str = KEEP_CALL_TYPE, box: Box = CLEAN_BOX) -> DataFrame:
    """Raw trips -> positions (id bigint, lon double, lat double)."""
    pos = pickup_point(has_track(filter_call_type(trips, call_type)))
    return in_bbox(pos.where(F.col("id").isNotNull()), box)
