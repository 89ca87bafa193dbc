"""Geographic rows derived from the star-schema tables, by integer arithmetic first and one division last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

LEVELS = (0, 5, 8, 10, 12, 14, 16)
TAG_KINDS = 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon_of(key: Column) -> Column:
    return (key.cast("long") * 7919 % 359999).cast("double") / 1000.0 - 180.0


def lat_of(key: Column) -> Column:
    return (key.cast("long") * 104729 % 169999).cast("double") / 1000.0 - 85.0


# Tags by event_id % 14, as pairs; the same list makes the SQL of the oracle.
TAGS = [
    {"highway": "motorway", "bridge": "yes"},
    {"highway": "trunk", "tunnel": "no"},
    {"highway": "primary", "tunnel": "yes", "bridge": "yes"},
    {"highway": "tertiary"},
    {"highway": "living_street", "name": " Side Lane "},
    {"highway": "service"},
    {"highway": "cycleway", "bridge": "no"},
    {"building": "yes", "height": "12.5m", "roof:shape": "hipped", "wall": "brick", "min_height": "3"},
    {"building": "yes", "building:levels": "4", "building:material": "steel", "building:min_level": "5"},
    {"building": "no", "natural": "water"},
    {"highway": "motorway_link", "leisure": "park"},
    {"boundary": "administrative", "amenity": "pub"},
    {"amenity": "cafe", "name": "Corner CAFE"},
    {"place": "town", "name": "Newport"},
]


def tags_column(key: Column) -> Column:
    """map<string,string> by key % 14; place and height values vary with the key."""
    out = F.lit(None).cast("map<string,string>")
    for i, pairs in enumerate(TAGS):
        out = F.when(key % TAG_KINDS == i, F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*map(F.lit, pairs.values())))).otherwise(out)
    return out


def sql_tags(key: str = "event_id") -> str:
    """The same tags as DuckDB rows (kind, key, value)."""
    return "(VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, p in enumerate(TAGS) for k, v in p.items()) + ") AS t(kind, k, v)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, lon, lat, tags."""
    return table(spark, sf_dir, "events").select("event_id", lon_of(F.col("event_id")).alias("lon"), lat_of(F.col("event_id")).alias("lat"), tags_column(F.col("event_id")).alias("tags"))


SQL_POINTS = "(SELECT event_id, (event_id * 7919 % 359999) / 1000.0 - 180.0 AS lon, (event_id * 104729 % 169999) / 1000.0 - 85.0 AS lat FROM events)"


def levels(spark: SparkSession, wanted=LEVELS) -> DataFrame:
    return spark.createDataFrame([(z,) for z in wanted], "level int")


def sql_levels(wanted=LEVELS) -> str:
    return "(VALUES " + ", ".join(f"({z})" for z in wanted) + ") AS levels(level)"


# DuckDB expressions of functions.grid.
def sql_mx(lon: str) -> str:
    return f"(({lon} + 180.0) / 360.0)"


def sql_my(lat: str) -> str:
    phi = f"radians(least(greatest({lat}, -85.05112877980659), 85.05112877980659))"
    return f"((1.0 - ln(tan({phi}) + 1.0 / cos({phi})) / pi()) / 2.0)"


def sql_grid(share: str, level: str) -> str:
    return f"CAST(least(greatest(CAST(round({share} * ((CAST(1 AS BIGINT) << ({level})) * 65536)) AS BIGINT), 0), (CAST(1 AS BIGINT) << ({level})) * 65536 - 1) AS BIGINT)"


def sql_tile(share: str, level: str) -> str:
    return f"CAST({sql_grid(share, level)} >> 16 AS INTEGER)"


def sql_cell(share: str, level: str) -> str:
    return f"CAST({sql_grid(share, level)} & 65535 AS INTEGER)"


def sql_lat(share: str) -> str:
    return f"degrees(atan(sinh(pi() * (1.0 - 2.0 * ({share})))))"


def sql_class(key: str = "event_id") -> str:
    """Class by key % 14, as functions.tags.classify() finds it from TAGS."""
    names = ["RoadMotorway", "RoadTrunk", "RoadPrimary", "RoadSecondary", "RoadResidential", "RoadService", "RoadPath", "Building", "Building", "Water", "Park", "Boundary", "Poi", "Label"]
    return f"[{', '.join(repr(n) for n in names)}][CAST({key} % 14 AS INTEGER) + 1]"


ENTRY_SQL = "(VALUES ('Land', 0.0), ('Water', 0.0), ('Park', 8.0), ('Building', 16.0), ('RoadMotorway', 5.0), ('RoadTrunk', 5.0), ('RoadPrimary', 8.0), ('RoadSecondary', 10.0), ('RoadResidential', 12.0), ('RoadService', 14.0), ('RoadPath', 14.0), ('Poi', 14.0), ('Label', 0.0), ('Boundary', 0.0)) AS entry(class, entry_zoom)"
