"""Deterministic synthetic scenes: coverage pyramids, height noise, and small scene tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import grid

# Fixed values.
LEVELS, CENTRE, SEA = (0, 5, 8, 10, 12, 14, 16), (-0.3049, 51.5149), -120.0
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)


def coverage(spark: SparkSession, levels=LEVELS, centre=CENTRE, reach: int = 1) -> DataFrame:
    """Distinct tiles within reach of the centre's tile at each level, inside the world."""
    z = spark.createDataFrame([(v,) for v in levels], "z int")
    at = grid.locate(F.lit(centre[0]), F.lit(centre[1]), F.col("z"))
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    t = z.select("z", at["x"].alias("cx"), at["y"].alias("cy")).withColumn("dx", step).withColumn("dy", step)
    t = t.select("z", (F.col("cx") + F.col("dx")).cast("long").alias("x"), (F.col("cy") + F.col("dy")).cast("long").alias("y"))
    return t.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < grid.side(F.col("z"))) & (F.col("y") < grid.side(F.col("z")))).distinct()


def lattice(ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
    """Hashed lattice values in [0, 1)."""
    a, b, c = (np.uint64(v) for v in MIX)
    with np.errstate(over="ignore"):
        h = ix.astype(np.int64).view(np.uint64) * a ^ iy.astype(np.int64).view(np.uint64) * b
        h = (h ^ (h >> np.uint64(29))) * c
    h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def value_noise(x: np.ndarray, y: np.ndarray, freq: int) -> np.ndarray:
    """Smooth noise over the world, periodic in x."""
    fx, fy = x * freq, y * freq
    ix, iy = np.floor(fx), np.floor(fy)
    ease = lambda t: t * t * (3 - 2 * t)
    tx, ty = ease(fx - ix), ease(fy - iy)
    at = lambda dx, dy: lattice(np.mod(ix + dx, freq).astype(np.int64), (iy + dy).astype(np.int64))
    top = at(0, 0) + (at(1, 0) - at(0, 0)) * tx
    low = at(0, 1) + (at(1, 1) - at(0, 1)) * tx
    return top + (low - top) * ty


def octaves(x: np.ndarray, y: np.ndarray, first: int, count: int, amplitude: float, gain: float) -> np.ndarray:
    return sum(amplitude * gain**k * (value_noise(x, y, first * 2**k) * 2 - 1) for k in range(count))


def noise_heights(tiles: DataFrame, side: int = grid.HEIGHT_SIDE) -> DataFrame:
    """tiles (z, x, y) with a raster of noise heights, stored little-endian."""
    @pandas_udf("binary")
    def raster(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(z, x, y, strict=True):
            unit = np.arange(side) / (side - 1)
            px, py = np.meshgrid((b + unit) / 2.0**a, (c + unit) / 2.0**a)
            h = np.maximum(octaves(px, py, 3, 4, 1400.0, 0.55), SEA)
            out.append(np.clip(np.floor(h + grid.HEIGHT_OFFSET + 0.5), 0, 65535).astype("<u2").tobytes())
        return pd.Series(out)

    return tiles.select("*", raster("z", "x", "y").alias("raster"))


def building_grid(spark: SparkSession, n: int = 6, size: int = 3000, gap: int = 9000) -> DataFrame:
    """n by n square buildings of one tile as parts, heights and materials by place."""
    from ..functions import style

    i, j = F.col("id") % n, F.floor(F.col("id") / n)
    x, y = (i * gap + 1000).cast("int"), (j * gap + 1000).cast("int")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    material = F.element_at(F.array(*map(F.lit, style.MATERIALS)), (F.col("id") % len(style.MATERIALS) + 1).cast("int"))
    roof = F.element_at(F.array(*map(F.lit, style.ROOFS)), (F.col("id") % len(style.ROOFS) + 1).cast("int"))
    b = F.struct(F.lit(0).alias("base_dm"), (F.lit(60) + (F.col("id") % 5).cast("int") * 30).alias("top_dm"), roof.alias("roof"), material.alias("material"))
    ring = F.array(corner(0, 0), corner(size, 0), corner(size, size), corner(0, size), corner(0, 0))
    nothing = F.array().cast("array<array<struct<x:int,y:int>>>")
    return spark.range(n * n).select("id", F.lit("Building").alias("class"), F.lit(0).alias("flags"), F.lit(3).alias("rank"), F.lit("").alias("name"), b.alias("building"), F.lit(16).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"), ring.alias("vertices"), nothing.alias("holes"))
