"""The style's dimension tables and ramps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, name, entry band, road rank (-1: no road), is an area, fill colour.
CLASSES = [
    (0, "Land", "World", -1, False, "F8F7F4FF"),
    (1, "Water", "World", -1, True, "C9D6DBFF"),
    (2, "Park", "City", -1, True, "E2EADDFF"),
    (3, "Building", "Micro", -1, True, "ECE9E4FF"),
    (4, "RoadMotorway", "Region", 6, False, "FFFFFFFF"),
    (5, "RoadTrunk", "Region", 5, False, "FFFFFFFF"),
    (6, "RoadPrimary", "City", 4, False, "FFFFFFFF"),
    (7, "RoadSecondary", "District", 3, False, "FFFFFFFF"),
    (8, "RoadResidential", "Street", 2, False, "FFFFFFFF"),
    (9, "RoadService", "Address", 1, False, "FFFFFFFF"),
    (10, "RoadPath", "Address", 0, False, "FFFFFFFF"),
    (11, "Poi", "Address", -1, False, "8A8A86FF"),
    (12, "Label", "World", -1, False, "3A3A37FF"),
    (13, "Boundary", "World", -1, False, "706484FF"),
]
BANDS = [("World", 0.0), ("Region", 5.0), ("City", 8.0), ("District", 10.0), ("Street", 12.0), ("Address", 14.0), ("Micro", 16.0)]
WIDTHS = {
    "RoadMotorway": [(5.0, 1.5), (10.0, 3.0), (14.0, 6.0), (18.0, 14.0)],
    "RoadTrunk": [(5.0, 1.2), (10.0, 2.5), (14.0, 5.0), (18.0, 12.0)],
    "RoadPrimary": [(8.0, 1.0), (12.0, 2.5), (16.0, 5.0), (18.0, 10.0)],
    "RoadSecondary": [(10.0, 1.0), (14.0, 2.5), (18.0, 8.0)],
    "RoadResidential": [(12.0, 1.0), (16.0, 3.0), (18.0, 6.0)],
    "RoadService": [(14.0, 0.8), (18.0, 4.0)],
    "RoadPath": [(14.0, 0.6), (18.0, 2.0)],
    "Boundary": [(0.0, 1.2), (8.0, 1.6), (18.0, 2.2)],
}
HYPSOMETRIC = [(0.0, "DEEAD6"), (400.0, "ECE8CE"), (1200.0, "E6D8BC"), (2400.0, "DCC8B0"), (3600.0, "F5F3F1")]
FACADES = {"Unknown": "ECE9E4FF", "Brick": "B66A4FFF", "Concrete": "B8B6B0FF", "Stone": "C9C2AEFF", "Glass": "9FC0CBFF", "Metal": "9A9EA3FF", "Wood": "9C7A54FF"}
BACKGROUND, CASING = "E3E5E7FF", "A8A6A1FF"
ROOFS = ["Flat", "Gabled", "Hipped", "Other"]
MATERIALS = ["Unknown", "Brick", "Concrete", "Stone", "Glass", "Metal", "Wood"]
SOURCE_KINDS = ["osm-pbf", "copernicus-dem", "gebco-grid", "water-polygons", "natural-earth-places", "natural-earth-boundaries", "natural-earth-roads"]
FLAG_ONE_WAY, FLAG_BRIDGE, FLAG_TUNNEL = 1, 2, 4
RAMP_SPAN, RELIEF_MAX = 0.5, 30.0

ENTRY = dict(BANDS)


def classes(spark: SparkSession) -> DataFrame:
    """code, name, band, entry_zoom, road_rank (null: no road), is_area, fill: fourteen rows."""
    rows = [(c, n, b, ENTRY[b], None if r < 0 else r, a, f) for c, n, b, r, a, f in CLASSES]
    return spark.createDataFrame(rows, "code int, name string, band string, entry_zoom double, road_rank int, is_area boolean, fill string")


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *b) for i, b in enumerate(BANDS)], "ordinal int, band string, entry_zoom double")


def lookup(pairs: dict, key: Column) -> Column:
    """A constant map's value for a key, null if there is none."""
    out = F.lit(None)
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def class_code(name: Column) -> Column:
    return lookup({n: c for c, n, *_ in CLASSES}, name)


def class_name(code: Column) -> Column:
    return lookup({c: n for c, n, *_ in CLASSES}, code)


def entry_zoom(name: Column) -> Column:
    return lookup({n: ENTRY[b] for _, n, b, *_ in CLASSES}, name)


def is_area(name: Column) -> Column:
    return name.isin(*[n for _, n, _, _, a, _ in CLASSES if a])


def road_rank(name: Column) -> Column:
    return lookup({n: r for _, n, _, r, _, _ in CLASSES if r >= 0}, name)


def band_at(zoom: Column) -> Column:
    """The deepest band entered at a zoom."""
    out = F.lit(BANDS[0][0])
    for name, entry in BANDS[1:]:
        out = F.when(zoom >= entry, F.lit(name)).otherwise(out)
    return out


def ramp(stops: list[tuple[float, float]], at: Column) -> Column:
    """Piecewise linear between stops, clamped outside."""
    out = F.lit(float(stops[-1][1]))
    for (z0, v0), (z1, v1) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(at <= z1, F.lit(v0) + F.lit(v1 - v0) * ((at - z0) / (z1 - z0))).otherwise(out)
    return F.when(at <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def road_width(name: Column, zoom: Column) -> Column:
    out = F.lit(0.0)
    for cls, stops in WIDTHS.items():
        out = F.when(name == cls, ramp(stops, zoom)).otherwise(out)
    return out


def class_alpha(name: Column, zoom: Column) -> Column:
    """Fades in over half a zoom from the entry; classes of the first band are always there."""
    entry = entry_zoom(name)
    return F.when(entry == 0.0, F.lit(1.0)).otherwise(F.least(F.greatest((zoom - entry) / RAMP_SPAN, F.lit(0.0)), F.lit(1.0)))


def tint(metres: Column) -> Column:
    """Hypsometric colour as an array of three channels."""
    channel = lambda i: F.round(ramp([(z, int(c[2 * i : 2 * i + 2], 16)) for z, c in HYPSOMETRIC], metres)).cast("int")
    return F.array(*[channel(i) for i in range(3)])


def relief_factor(expressiveness: Column) -> Column:
    return 1.0 + (RELIEF_MAX - 1.0) * F.least(F.greatest(expressiveness, F.lit(0.0)), F.lit(1.0))


def building_lod(zoom: Column) -> Column:
    return F.when(zoom >= 19, "full").when(zoom >= 17, "simplified").otherwise("footprint")


def label_rank_limit(level: Column) -> Column:
    return F.when(level <= 5, 0).when(level <= 10, 1).when(level <= 13, 2).otherwise(3)
