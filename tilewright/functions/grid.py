"""Web Mercator and the integer tile grid as column expressions.

Points go to a 65536 grid inside a tile (`locate`); clipped geometry is quantised on a 65535 scale (`quantised`); the inverse
always uses 65536, so a clipped vertex comes back up to one step off.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_LATITUDE = 85.05112877980659
EXTENT = 65536
MAX_LEVEL = 22
TILE_PIXELS = 256.0
EARTH_METRES = 40075016.68557849
MERCATOR_RADIUS = 6378137.0
METRES_PER_DEGREE = 111320.0
HEIGHT_SIDE = 256
HEIGHT_OFFSET = 11000
TERRAIN_MAX_LEVEL = 12


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def mercator_x(lon: Column) -> Column:
    """Share of the world's width; longitude is not wrapped."""
    return (lon + 180.0) / 360.0


def mercator_y(lat: Column) -> Column:
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    return (1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0


def inverse_lon(x: Column) -> Column:
    return x * 360.0 - 180.0


def inverse_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y))))


def side(level) -> Column:
    """Tiles across the world at a level."""
    return F.expr("1L") * F.shiftleft(F.lit(1).cast("long"), level) if isinstance(level, int) else F.call_function("shiftleft", F.lit(1).cast("long"), _c(level).cast("int"))


def grid_index(share: Column, level) -> Column:
    """A share of the world as a position on the level's grid, clamped to it."""
    cells = side(level) * EXTENT
    return F.least(F.greatest(F.round(share * cells).cast("long"), F.lit(0).cast("long")), cells - 1)


def locate(lon: Column, lat: Column, level) -> dict[str, Column]:
    """z, x, y, cx, cy of a point; levels beyond the last are clamped."""
    z = min(level, MAX_LEVEL) if isinstance(level, int) else F.least(_c(level), F.lit(MAX_LEVEL))
    gx, gy = grid_index(mercator_x(lon), z), grid_index(mercator_y(lat), z)
    cell = lambda g: g.bitwiseAND(F.lit(EXTENT - 1)).cast("int")
    return {"z": _c(z).cast("int"), "x": F.shiftright(gx, 16).cast("int"), "y": F.shiftright(gy, 16).cast("int"), "cx": cell(gx), "cy": cell(gy)}


def lon_at(level, x: Column, cx) -> Column:
    return inverse_lon((x * EXTENT + _c(cx)).cast("double") / (side(level) * EXTENT).cast("double"))


def lat_at(level, y: Column, cy) -> Column:
    return inverse_lat((y * EXTENT + _c(cy)).cast("double") / (side(level) * EXTENT).cast("double"))


def world_pixels(zoom: Column) -> Column:
    """Pixels across the world at a fractional zoom."""
    return F.pow(F.lit(2.0), _c(zoom)) * TILE_PIXELS


def world_px(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    world = world_pixels(zoom)
    return mercator_x(lon) * world, mercator_y(lat) * world


def lonlat_at_px(px: Column, py: Column, zoom: Column) -> tuple[Column, Column]:
    world = world_pixels(zoom)
    return inverse_lon(px / world), inverse_lat(py / world)


def tile_units(lon: Column, lat: Column, level) -> tuple[Column, Column]:
    """A point in units of the level's tiles."""
    n = side(level).cast("double")
    return mercator_x(lon) * n, mercator_y(lat) * n


def quantised(units: Column, tile: Column) -> Column:
    """A clipped coordinate as a step of its tile, on the 65535 scale, clamped."""
    return F.least(F.greatest(F.round((units - tile) * 65535.0), F.lit(0.0)), F.lit(65535.0)).cast("int")


def metres_to_px(metres: Column, lat: Column, zoom: Column) -> Column:
    return metres * (world_pixels(zoom) / (EARTH_METRES * F.cos(F.radians(lat))))


def step_metres(level, lat: Column) -> Column:
    return EARTH_METRES * F.cos(F.radians(lat)) / (side(level) * EXTENT).cast("double")


def texel_metres(level, lat: Column) -> Column:
    """Ground between two samples of a tile's height raster."""
    return EARTH_METRES * F.cos(F.radians(lat)) / side(level).cast("double") / float(HEIGHT_SIDE - 1)


def from_mercator_metres(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(2.0 * F.atan(F.exp(y / MERCATOR_RADIUS)) - math.pi / 2)


def metres_between(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular distance with the cosine of the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2.0)) * METRES_PER_DEGREE
    return F.hypot(dx, (lat2 - lat1) * METRES_PER_DEGREE)


def tolerance(level) -> Column:
    """Generalisation tolerance in tiles."""
    gap = F.greatest(F.lit(16) - _c(level), F.lit(0))
    return F.pow(F.lit(2.0), gap.cast("double")) * 2.0 / 65535.0


def terrain_cap(metres: Column) -> Column:
    """The deepest level whose height samples are no finer than the source; unusable spacings get the fixed cap."""
    deepest = F.floor(F.log2(F.lit(EARTH_METRES / 255.0) / metres))
    good = metres.isNotNull() & ~F.isnan(metres) & (metres > 0) & (metres < float("inf"))
    return F.when(good, F.least(F.greatest(deepest, F.lit(0)), F.lit(MAX_LEVEL)).cast("int")).otherwise(F.lit(TERRAIN_MAX_LEVEL))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """From a point to a segment, with the foot clamped to it; a segment of no length is its first point."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / F.when(length > 2.220446049250313e-16, length), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.hypot(px - ax - t * dx, py - ay - t * dy), F.hypot(px - ax, py - ay))


def encode_height(metres: Column) -> Column:
    return F.least(F.greatest(F.round(metres + float(HEIGHT_OFFSET)), F.lit(0.0)), F.lit(65535.0)).cast("int")


def decode_height(value: Column) -> Column:
    return value - HEIGHT_OFFSET


def tile_span(lon, lat, zoom, level, width, height) -> dict[str, Column]:
    """First and last tile columns and rows that a viewport touches at a level, unclamped; bearing and tilt do not count."""
    z = F.greatest(_c(zoom).cast("double"), _c(level).cast("double"))
    tile = world_pixels(z) / side(level).cast("double")
    px, py = world_px(lon, lat, z)
    edge = lambda v: F.floor(v / tile).cast("long")
    return {"x0": edge(px - _c(width) / 2.0), "y0": edge(py - _c(height) / 2.0), "x1": edge(px + _c(width) / 2.0), "y1": edge(py + _c(height) / 2.0)}


def tile_path(z, x, y) -> Column:
    return F.concat_ws("/", _c(z).cast("string"), x.cast("string"), F.concat(y.cast("string"), F.lit(".mt2")))


PATH = "^([0-9]+)/([0-9]+)/([0-9]+)\\.mt2$"


def parse_path(path: Column) -> dict[str, Column]:
    """z, x, y of a tile path, null where it is none (absolute, with dots, or of another shape)."""
    part = lambda i: F.when(path.rlike(PATH), F.regexp_extract(path, PATH, i)).try_cast("int")
    return {"z": part(1), "x": part(2), "y": part(3)}


def globeness(zoom: Column) -> Column:
    """1 on the globe, 0 on the sheet, smooth between zoom 3.5 and 4.5."""
    t = F.least(F.greatest(zoom - 3.5, F.lit(0.0)), F.lit(1.0))
    return 1.0 - t * t * (3.0 - 2.0 * t)
