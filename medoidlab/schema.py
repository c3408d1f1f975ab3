"""Schemas, default boxes and constants shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values that results depend on (must stay as they are).
# Earth radius used by the haversine distance, in metres.
EARTH_RADIUS_M = 6378137.0
# Cleaning box, strict on every side: 41 < lat < 42, -8.7 < lon < -8.4.
CLEAN_MIN_LAT = 41.0
CLEAN_MAX_LAT = 42.0
CLEAN_MIN_LON = -8.7
CLEAN_MAX_LON = -8.4
# Drawing area: lat 41.05 .. 41.35, lon -8.7 .. -8.4, 2000 x 2000 pixels.
IMAGE_MIN_LAT = 41.05
IMAGE_MAX_LAT = 41.35
IMAGE_MIN_LON = -8.7
IMAGE_MAX_LON = -8.4
IMAGE_SIZE = 2000
# Alpha of the whole-dataset picture and of a clustering picture; centre square side.
ALPHA_DATASET = 0.8
ALPHA_CLUSTERING = 0.6
CENTER_SQUARE = 10
# Algorithm bits of the sweep.
ALG_PAM = 1
ALG_CLARA = 2
ALG_CLARAFAST = 4
ALG_CLARANS = 8
ALG_KMEANS = 16
ALGORITHM_NAMES = {
    ALG_PAM: "PAM",
    ALG_CLARA: "CLARA",
    ALG_CLARAFAST: "CLARAFAST",
    ALG_CLARANS: "CLARANS",
    ALG_KMEANS: "KMEANS",
}
# The call type kept by the cleaner and the minimum track text length (exclusive).
KEEP_CALL_TYPE = "C"
MIN_TRACK_CHARS = 5
# k-means iterations of the sweep.
KMEANS_ITERATIONS = 60
# Raw trip columns, in header order.
TRIP_COLUMNS = [
    "TRIP_ID",
    "CALL_TYPE",
    "ORIGIN_CALL",
    "ORIGIN_STAND",
    "TAXI_ID",
    "TIMESTAMP",
    "DAY_TYPE",
    "MISSING_DATA",
    "POLYLINE",
]


@dataclass(frozen=True)
class Box:
    """Axis-aligned lon/lat box. ``strict`` boxes exclude their edges."""

    min_lon: float
    max_lon: float
    min_lat: float
    max_lat: float

    @property
    def width(self) -> float:
        return self.max_lon - self.min_lon

    @property
    def height(self) -> float:
        return self.max_lat - self.min_lat


CLEAN_BOX = Box(CLEAN_MIN_LON, CLEAN_MAX_LON, CLEAN_MIN_LAT, CLEAN_MAX_LAT)
IMAGE_BOX = Box(IMAGE_MIN_LON, IMAGE_MAX_LON, IMAGE_MIN_LAT, IMAGE_MAX_LAT)

TRIP_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in TRIP_COLUMNS])

# In-memory positions: (id, lon, lat).
POSITION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("lon", T.DoubleType(), True),
        T.StructField("lat", T.DoubleType(), True),
    ]
)

# On-disk JSON positions use the getter names of the original bean.
POSITION_JSON_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("pickupLatitude", T.DoubleType(), True),
        T.StructField("pickupLongitude", T.DoubleType(), True),
    ]
)

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("k", T.IntegerType(), False),
        T.StructField("algorithm", T.StringType(), False),
        T.StructField("time_ms", T.LongType(), True),
        T.StructField("phi", T.DoubleType(), True),
        T.StructField(
            "centers",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("lat", T.DoubleType(), False),
                        T.StructField("lon", T.DoubleType(), False),
                    ]
                )
            ),
            True,
        ),
    ]
)
