"""Feature tags (map<string,string>) to classes and attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import style

# Fixed values.
ROADS = {
    "motorway": "RoadMotorway",
    "trunk": "RoadTrunk",
    "primary": "RoadPrimary",
    "secondary": "RoadSecondary",
    "tertiary": "RoadSecondary",
    "residential": "RoadResidential",
    "living_street": "RoadResidential",
    "unclassified": "RoadResidential",
    "service": "RoadService",
    "footway": "RoadPath",
    "path": "RoadPath",
    "cycleway": "RoadPath",
}
PLACE_RANK = {"city": 0, "town": 1, "village": 2, "borough": 2, "suburb": 2}
ROOF = {"gabled": "Gabled", "hipped": "Hipped", "pyramidal": "Hipped"}
MATERIAL = {"brick": "Brick", "concrete": "Concrete", "stone": "Stone", "glass": "Glass", "metal": "Metal", "steel": "Metal", "wood": "Wood", "timber_framing": "Wood"}
DEFAULT_HEIGHT, LEVEL_HEIGHT = 9.0, 3.0


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def positive(text: Column) -> Column:
    """A finite positive number, else null."""
    n = text.try_cast("float")
    return F.when((n > 0) & (n < float("inf")), n)


def metres(text: Column) -> Column:
    """As positive(), without one trailing m."""
    return positive(F.trim(F.regexp_replace(F.trim(text), "m$", "")))


def classify(tags: Column) -> Column:
    """The class of a feature, null if none; a highway that is no known road falls through to the later rules."""
    t = lambda k: tag(tags, k)
    return F.coalesce(
        style.lookup(ROADS, t("highway")).cast("string"),
        F.when(t("building") != "no", F.lit("Building")),
        F.when(t("natural") == "water", F.lit("Water")),
        F.when(t("leisure") == "park", F.lit("Park")),
        F.when(t("boundary") == "administrative", F.lit("Boundary")),
        F.when(t("amenity").isNotNull(), F.lit("Poi")),
        F.when(t("place").isNotNull(), F.lit("Label")),
    )


def rank(tags: Column) -> Column:
    return F.coalesce(style.lookup(PLACE_RANK, tag(tags, "place")), F.lit(3)).cast("int")


def flags(tags: Column) -> Column:
    """Bridge and tunnel bits; the one-way bit is never set."""
    bit = lambda k, b: F.when(tag(tags, k) != "no", F.lit(b)).otherwise(F.lit(0))
    return bit("bridge", style.FLAG_BRIDGE).bitwiseOR(bit("tunnel", style.FLAG_TUNNEL))


def height(tags: Column) -> Column:
    """struct<source, metres>: the height tag, else levels, else a default."""
    explicit, levels = metres(tag(tags, "height")), positive(tag(tags, "building:levels"))
    source = F.when(explicit.isNotNull(), F.lit("Explicit")).when(levels.isNotNull(), F.lit("Levels")).otherwise(F.lit("Default"))
    return F.struct(source.alias("source"), F.coalesce(explicit, (levels * LEVEL_HEIGHT).cast("float"), F.lit(DEFAULT_HEIGHT).cast("float")).alias("metres"))


def decimetres(value: Column) -> Column:
    return F.least(F.greatest(F.round(value.cast("double") * 10.0), F.lit(0.0)), F.lit(65535.0)).cast("int")


def base_dm(tags: Column) -> Column:
    low = F.coalesce(metres(tag(tags, "min_height")), (positive(tag(tags, "building:min_level")) * LEVEL_HEIGHT).cast("float"))
    return F.coalesce(decimetres(low), F.lit(0))


def roof(tags: Column) -> Column:
    shape = tag(tags, "roof:shape")
    return F.when(shape.isNull(), F.lit("Flat")).otherwise(F.coalesce(style.lookup(ROOF, shape).cast("string"), F.lit("Other")))


def material(tags: Column) -> Column:
    said = F.coalesce(tag(tags, "building:material"), tag(tags, "building:facade:material"), tag(tags, "wall"))
    return F.coalesce(style.lookup(MATERIAL, said).cast("string"), F.lit("Unknown"))


def building(cls: Column, tags: Column) -> Column:
    """struct<base_dm, top_dm, roof, material> of a building, else null; a base at or above the top falls to 0."""
    top, base = decimetres(height(tags)["metres"]), base_dm(tags)
    return F.when(cls == "Building", F.struct(F.when(top > base, base).otherwise(0).alias("base_dm"), top.alias("top_dm"), roof(tags).alias("roof"), material(tags).alias("material")))


def eligible(cls: Column, ranked: Column, level: Column) -> Column:
    """Whether a class is admitted at a level; labels must also be important enough."""
    return (level >= style.entry_zoom(cls)) & ((cls != "Label") | (ranked <= style.label_rank_limit(level)))


def place_name(name: Column) -> Column:
    return F.lower(F.trim(name))
