"""Height rasters: sampling, resampling, mosaics, gradients and the packed codec.

Grids are rows (grid_id, ordinal, west, south, east, north, width, height, samples array<float>), row by row from the north.
Cells are exploded only where a query asks for all of them; whole-raster codecs run over Arrow batches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from . import residency

# Fixed values.
SIDE = grid.HEIGHT_SIDE
RASTER_BYTES, PACK_LEVEL, WINDOW_CELLS = SIDE * SIDE * 2, 9, 4 << 20
LIGHT_AZIMUTH, LIGHT_ALTITUDE, HIGHLIGHT_GAIN = 315.0, 45.0, 0.35
#: Samples of a block; a block travels with the samples that fall in it.
BLOCK_CELLS = 1 << 16
BELOW_ONE = 1.0 - 2.220446049250313e-16


def valid(g: Column) -> Column:
    """Non-empty, finite ordered bounds, and as many samples as cells."""
    box = [g[c] for c in ("west", "south", "east", "north")]
    finite = F.lit(True)
    for c in box:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(finite & (g["west"] < g["east"]) & (g["south"] < g["north"]) & (g["width"] > 0) & (g["height"] > 0) & (F.size(g["samples"]) == g["width"].cast("long") * g["height"]), F.lit(False))


def cell(offset: Column, span: Column, cells: Column) -> Column:
    """The cell that an offset falls in, clamped to the grid."""
    return F.floor(F.least(F.greatest(offset / span, F.lit(0.0)), F.lit(BELOW_ONE)) * cells).cast("int")


def cell_index(g, lon: Column, lat: Column) -> Column:
    """The place of the nearest cell in a grid's samples."""
    x = cell(lon - g["west"], g["east"] - g["west"], g["width"])
    y = cell(g["north"] - lat, g["north"] - g["south"], g["height"])
    return y * g["width"] + x


def sample(g: Column, lon: Column, lat: Column) -> Column:
    """The nearest cell's sample."""
    return F.get(g["samples"], cell_index(g, lon, lat))


def raster_coord(index: Column) -> Column:
    """Where sample `index` of a tile's raster lies on the tile's grid: the outer samples stand on the edges."""
    return F.floor(index * 65535 / (SIDE - 1)).cast("int")


def covering_grid(tiles: DataFrame, grids: DataFrame) -> DataFrame:
    """tiles (z, x, y) with the first grid, by ordinal, that covers all four corners; null if none.

    A plan has a handful of grids, whose boxes alone are joined."""
    z = F.col("z")
    lon = lambda c: grid.lon_at(z, F.col("x").cast("long"), c)
    lat = lambda c: grid.lat_at(z, F.col("y").cast("long"), c)
    box = grids.select("grid_id", "ordinal", "west", "south", "east", "north")
    t = tiles.withColumns({"_w": lon(0), "_e": lon(65535), "_n": lat(0), "_s": lat(65535)})
    hit = t.join(F.broadcast(box), F.expr("_w >= west and _e <= east and _n <= north and _s >= south"))
    best = hit.groupBy("z", "x", "y").agg(F.min_by("grid_id", "ordinal").alias("grid_id"))
    return tiles.join(best, ["z", "x", "y"], "left")


def blocks(grids: DataFrame, cells: int = BLOCK_CELLS) -> DataFrame:
    """(grid_id, block, samples): a grid's samples in runs of `cells`, so that no join moves a whole grid with every sample."""
    of = F.explode(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / cells).cast("int"))).alias("block")
    return grids.where(F.size("samples") > 0).select("grid_id", of, "samples").select("grid_id", "block", F.slice("samples", F.col("block") * cells + 1, F.lit(cells)).alias("samples"))


def resampled(tiles: DataFrame, grids: DataFrame, side: int = SIDE, block: int = BLOCK_CELLS) -> DataFrame:
    """(z, x, y, i, j, stored): the tile's raster samples, row i column j, encoded; tiles name their grid_id.

    Samples meet the blocks of their grid that they fall in; only the grids' boxes, a plan's handful, are broadcast.  A tile whose
    grid is missing or has no samples gives no rows."""
    step = 65535 // (side - 1) if side != SIDE else None
    at = lambda c: raster_coord(F.col(c)) if step is None else (F.col(c) * step).cast("int")
    cells = tiles.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    placed = cells.withColumns({"lon": grid.lon_at(F.col("z"), F.col("x").cast("long"), at("j")), "lat": grid.lat_at(F.col("z"), F.col("y").cast("long"), at("i"))})
    box = grids.select("grid_id", "west", "south", "east", "north", "width", "height")
    index = cell_index({c: F.col(c) for c in box.columns}, F.col("lon"), F.col("lat"))
    met = placed.join(F.broadcast(box), "grid_id").withColumn("index", index).withColumn("block", F.floor(F.col("index") / block).cast("int"))
    met = met.select("z", "x", "y", "i", "j", "grid_id", "index", "block").join(blocks(grids, block), ["grid_id", "block"])
    return met.select("z", "x", "y", "i", "j", grid.encode_height(F.get("samples", F.col("index") % block).cast("double")).alias("stored"))


def decimated(cells: DataFrame, stride: int) -> DataFrame:
    """Every stride-th sample on both axes; cells: grid_id, row, col, v."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    return cells.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0)).withColumns({"row": F.floor(F.col("row") / stride).cast("int"), "col": F.floor(F.col("col") / stride).cast("int")})


def window(west: float, south: float, east: float, north: float, box: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int]:
    """Half-open pixel rectangle (col0, row0, col1, row1) of a geographic window inside a grid's box."""
    w, s, e, n = box
    if not (west < east and south < north) or east <= w or west >= e or north <= s or south >= n:
        raise ValueError("the window does not meet the grid")
    col0, col1 = max(0, int(np.floor((west - w) / (e - w) * width))), min(width, int(np.ceil((east - w) / (e - w) * width)))
    row0, row1 = max(0, int(np.floor((n - north) / (n - s) * height))), min(height, int(np.ceil((n - south) / (n - s) * height)))
    if (col1 - col0) * (row1 - row0) > WINDOW_CELLS:
        raise ValueError("the window holds too many cells")
    return col0, row0, col1, row1


def windowed(chunks: DataFrame, rect: tuple[int, int, int, int]) -> DataFrame:
    """The chunks (row0, col0, h, w, samples) that a pixel rectangle meets; a range predicate that reaches the scan."""
    c0, r0, c1, r1 = rect
    return chunks.where((F.col("col0") < c1) & (F.col("row0") < r1) & (F.col("col0") + F.col("w") > c0) & (F.col("row0") + F.col("h") > r0))


def mosaic_bounds(grids: DataFrame) -> DataFrame:
    return grids.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def mosaic(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells of equal-sized grids as one grid's: rows and columns shifted by each grid's place.  Unequal sizes are an error."""
    box = mosaic_bounds(grids).select(*[F.col(c).alias(f"m_{c}") for c in ("west", "south", "east", "north")])
    size = grids.agg(F.min("width").alias("w0"), F.max("width").alias("w1"), F.min("height").alias("h0"), F.max("height").alias("h1"))
    fits = F.expr("w0 = w1 and h0 = h1")
    one = box.withColumn("k", F.lit(1)).join(size.withColumn("k", F.lit(1)), "k").drop("k")
    place = grids.withColumn("k", F.lit(1)).join(F.broadcast(one.withColumn("k", F.lit(1))), "k")
    col = F.round((F.col("west") - F.col("m_west")) / (F.col("east") - F.col("west"))) * F.col("width")
    row = F.round((F.col("m_north") - F.col("north")) / (F.col("north") - F.col("south"))) * F.col("height")
    place = place.select("grid_id", F.when(fits, col).otherwise(F.raise_error(F.lit("grids differ in size"))).cast("int").alias("dc"), row.cast("int").alias("dr"))
    return cells.join(F.broadcast(place), "grid_id").select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "v")


def at_clamped(raster: Column, x: Column, y: Column, side: int = SIDE) -> Column:
    """Metres of a stored raster (array<int>) with its edges repeated."""
    inside = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(side - 1))
    return grid.decode_height(F.get(raster, inside(y) * side + inside(x)))


def bilinear(raster: Column, x: Column, y: Column, side: int = SIDE) -> Column:
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    fx, fy = x - x0, y - y0
    m = lambda dx, dy: at_clamped(raster, x0 + dx, y0 + dy, side)
    top, low = m(0, 0) + (m(1, 0) - m(0, 0)) * fx, m(0, 1) + (m(1, 1) - m(0, 1)) * fx
    return top + (low - top) * fy


def gradient(raster: Column, x: Column, y: Column, texel: Column, factor: Column, side: int = SIDE) -> Column:
    """struct<east, north> by central differences; row numbers grow southwards."""
    m = lambda dx, dy: at_clamped(raster, x + dx, y + dy, side)
    return F.struct(((m(1, 0) - m(-1, 0)) / (texel * 2) * factor).alias("east"), ((m(0, -1) - m(0, 1)) / (texel * 2) * factor).alias("north"))


def shade(east: Column, north: Column) -> Column:
    """Brightness under the fixed light relative to flat ground; highlights beyond it are softened."""
    a, h = np.radians(LIGHT_AZIMUTH), np.radians(LIGHT_ALTITUDE)
    lx, ly, lz = float(np.sin(a) * np.cos(h)), float(np.cos(a) * np.cos(h)), float(np.sin(h))
    raw = F.greatest((-east * lx - north * ly + lz) / F.sqrt(east * east + north * north + 1.0), F.lit(0.0)) / lz
    return F.when(raw > 1.0, 1.0 + (raw - 1.0) * HIGHLIGHT_GAIN).otherwise(raw)


def _predictions(v: np.ndarray) -> np.ndarray:
    """Paeth predictor of every sample from left, above and above-left; zero beyond the raster."""
    padded = np.pad(v.astype(np.int32), ((1, 0), (1, 0)))
    left, above, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    p = left + above - corner
    pl, pa_, pc = abs(p - left), abs(p - above), abs(p - corner)
    return np.where((pl <= pa_) & (pl <= pc), left, np.where(pa_ <= pc, above, corner))


def pack(raster: bytes, side: int = SIDE) -> bytes:
    """Residuals modulo 2**16, high bytes then low bytes, raw deflate."""
    v = np.frombuffer(raster, "<u2")
    if len(v) != side * side:
        raise ValueError("a raster of another size")
    v = v.reshape(side, side)
    r = (v.astype(np.int32) - _predictions(v)) & 0xFFFF
    deflate = zlib.compressobj(PACK_LEVEL, zlib.DEFLATED, -15)
    return deflate.compress((r >> 8).astype(np.uint8).tobytes() + (r & 255).astype(np.uint8).tobytes()) + deflate.flush()


def unpack(packed: bytes, side: int = SIDE) -> bytes:
    """The raster of pack(); anything that does not inflate to exactly its size is an error."""
    inflate = zlib.decompressobj(-15)
    try:
        planes = inflate.decompress(packed, side * side * 2 + 1)
    except zlib.error as e:
        raise ValueError("a damaged raster") from e
    if len(planes) != side * side * 2:
        raise ValueError("a raster of another size")
    high, low = np.frombuffer(planes, np.uint8).reshape(2, side, side).astype(np.int64)
    residual = (high << 8 | low).tolist()
    rows, above = [], [0] * (side + 1)
    for r in residual:
        row = [0]
        for x in range(side):
            a, b, c = row[x], above[x + 1], above[x]
            p = a + b - c
            da, db, dc = abs(p - a), abs(p - b), abs(p - c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
            row.append((r[x] + guess) & 0xFFFF)
        rows.append(row[1:])
        above = row
    return np.array(rows, "<u2").tobytes()


def packed(df: DataFrame, column: str = "raster", side: int = SIDE, back: bool = False) -> DataFrame:
    """df with a raster column packed, or with back unpacked again."""
    work = unpack if back else pack

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(column)
            yield b.set_column(i, column, pa.array([None if v is None else work(v, side) for v in b.column(i).to_pylist()], pa.binary()))

    return df.mapInArrow(run, df.schema)


def centre_heights(cameras: DataFrame, rasters: DataFrame, depth: int = 4, side: int = SIDE) -> DataFrame:
    """cameras (session, lon, lat, level) with `height`: the metres under the centre, null where no raster can answer.

    The raster is that of the centre's tile at its level or of its nearest held ancestor, sampled between four samples through the
    ancestor's window.  rasters: z, x, y and raster, side * side stored samples; of several for one tile one answers."""
    at = grid.locate(F.col("lon"), F.col("lat"), F.col("level"))
    c = cameras.select(*cameras.columns, *[at[k].alias(k) for k in ("z", "x", "y", "cx", "cy")])
    met = residency.nearest_ancestor(c, rasters, depth)
    one = rasters.select(F.col("z").alias("sz"), F.col("x").alias("sx"), F.col("y").alias("sy"), "raster").dropDuplicates(["sz", "sx", "sy"])
    texel = lambda g, off: (F.col(off) + F.col(g) / 65535.0 * F.col("scale")) * float(side - 1)
    height = bilinear(F.col("raster"), texel("cx", "offset_x"), texel("cy", "offset_y"), side)
    return met.join(one, ["sz", "sx", "sy"], "left").select(*cameras.columns, height.alias("height"))
