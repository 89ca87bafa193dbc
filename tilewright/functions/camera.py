"""Camera projection: the Mercator sheet and the orthographic globe, blended by globeness, then turned by the bearing.

A camera is a dict of columns lon, lat, zoom, bearing.  Offsets are pixels from the viewport's centre, y down.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import grid

# Fixed values.
STEPS, CLOSE_PX, STEP_DEGREES = 6, 1e-6, 1e-6


def _turn(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def _sheet_scale(camera: dict, g: Column) -> Column:
    return (1.0 - g) + g * F.cos(F.radians(camera["lat"]))


def sheet(lon: Column, lat: Column, camera: dict) -> tuple[Column, Column]:
    """Offset on the sheet, the short way round the antimeridian."""
    world = grid.world_pixels(camera["zoom"])
    px, py = grid.world_px(lon, lat, camera["zoom"])
    cx, cy = grid.world_px(camera["lon"], camera["lat"], camera["zoom"])
    dx = px - cx
    dx = F.when(dx > world / 2.0, dx - world).when(dx < -world / 2.0, dx + world).otherwise(dx)
    scale = _sheet_scale(camera, grid.globeness(camera["zoom"]))
    return dx * scale, (py - cy) * scale


def globe(lon: Column, lat: Column, camera: dict, relief: float = 1.0) -> tuple[Column, Column, Column]:
    """Offset on the globe and the cosine that is negative behind it."""
    p0, p, d = F.radians(camera["lat"]), F.radians(lat), F.radians(lon) - F.radians(camera["lon"])
    g = grid.globeness(camera["zoom"])
    radius = ((1.0 - g) / F.cos(p0) + g) * grid.world_pixels(camera["zoom"]) / (2.0 * math.pi) * relief
    x = F.cos(p) * F.sin(d)
    y = F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(d)
    return x * radius, -y * radius, F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(d)


def _offset(lon: Column, lat: Column, camera: dict) -> tuple[Column, Column]:
    g = grid.globeness(camera["zoom"])
    (fx, fy), (gx, gy, _) = sheet(lon, lat, camera), globe(lon, lat, camera)
    return (1.0 - g) * fx + g * gx, (1.0 - g) * fy + g * gy


def project(lon: Column, lat: Column, camera: dict) -> dict[str, Column]:
    """x, y and front; a point with front below zero is behind the globe."""
    g = grid.globeness(camera["zoom"])
    x, y = _turn(*_offset(lon, lat, camera), -camera["bearing"])
    return {"x": x, "y": y, "front": globe(lon, lat, camera)[2] * g + (1.0 - g)}


def unproject_sheet(x: Column, y: Column, camera: dict) -> tuple[Column, Column]:
    """lon and lat of an offset where the world is a sheet (globeness 0)."""
    tx, ty = _turn(x, y, camera["bearing"])
    scale = _sheet_scale(camera, grid.globeness(camera["zoom"]))
    cx, cy = grid.world_px(camera["lon"], camera["lat"], camera["zoom"])
    return grid.lonlat_at_px(cx + tx / scale, cy + ty / scale, camera["zoom"])


def unproject(df, x: str, y: str, camera: dict[str, str]):
    """df with lon and lat of the offsets, by Newton steps from the sheet's inverse; vectorised over Arrow batches."""
    rad, top = np.radians, grid.MAX_LATITUDE

    def offset(lon, lat, c):
        t = np.clip(c["zoom"] - 3.5, 0, 1)
        g = 1 - t * t * (3 - 2 * t)
        world = 256.0 * 2.0 ** c["zoom"]
        my = lambda v: (1 - np.log(np.tan(rad(np.clip(v, -top, top))) + 1 / np.cos(rad(np.clip(v, -top, top)))) / np.pi) / 2
        dx = (lon - c["lon"]) / 360 * world
        dx = np.where(dx > world / 2, dx - world, np.where(dx < -world / 2, dx + world, dx))
        scale = (1 - g) + g * np.cos(rad(c["lat"]))
        p0, p, d = rad(c["lat"]), rad(lat), rad(lon - c["lon"])
        radius = ((1 - g) / np.cos(p0) + g) * world / (2 * np.pi)
        gx, gy = np.cos(p) * np.sin(d) * radius, -(np.cos(p0) * np.sin(p) - np.sin(p0) * np.cos(p) * np.cos(d)) * radius
        return (1 - g) * dx * scale + g * gx, (1 - g) * (my(lat) - my(c["lat"])) * world * scale + g * gy, scale, world, my

    @pandas_udf("struct<lon:double,lat:double>")
    def solve(x: pd.Series, y: pd.Series, lon: pd.Series, lat: pd.Series, zoom: pd.Series, bearing: pd.Series) -> pd.DataFrame:
        c = {"lon": lon.to_numpy(float), "lat": lat.to_numpy(float), "zoom": zoom.to_numpy(float)}
        a = rad(bearing.to_numpy(float))
        tx, ty = x * np.cos(a) - y * np.sin(a), x * np.sin(a) + y * np.cos(a)
        _, _, scale, world, my = offset(c["lon"], c["lat"], c)
        at_lon = c["lon"] + tx.to_numpy(float) / scale / world * 360
        yn = my(c["lat"]) + ty.to_numpy(float) / scale / world
        at_lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * yn))))
        for _ in range(STEPS):
            bx, by, *_ = offset(at_lon, at_lat, c)
            rx, ry = bx - tx, by - ty
            ex, ey, *_ = offset(at_lon + STEP_DEGREES, at_lat, c)
            nx, ny, *_ = offset(at_lon, at_lat + STEP_DEGREES, c)
            a11, a21, a12, a22 = (ex - bx) / STEP_DEGREES, (ey - by) / STEP_DEGREES, (nx - bx) / STEP_DEGREES, (ny - by) / STEP_DEGREES
            det = a11 * a22 - a12 * a21
            go = (np.hypot(rx, ry) >= CLOSE_PX) & (np.abs(det) >= 2.220446049250313e-16)
            safe = np.where(go, det, 1)
            at_lon = np.where(go, at_lon + (ry * a12 - rx * a22) / safe, at_lon)
            at_lat = np.where(go, np.clip(at_lat + (rx * a21 - ry * a11) / safe, -top, top), at_lat)
        return pd.DataFrame({"lon": at_lon, "lat": at_lat})

    found = solve(F.col(x).cast("double"), F.col(y).cast("double"), *[F.col(camera[k]).cast("double") for k in ("lon", "lat", "zoom", "bearing")])
    return df.withColumn("_at", found).select(*df.columns, F.col("_at.lon").alias("lon_at"), F.col("_at.lat").alias("lat_at"))


def tile_frame(z, x: Column, y: Column) -> dict[str, Column]:
    """Origin and span of a tile as shares of the world."""
    n = grid.side(z).cast("double")
    return {"origin_x": x / n, "origin_y": y / n, "span": 1.0 / n}


def measured(text: Column, advances: dict[str, float], size: Column) -> Column:
    """Width of a line of text: advances of its known characters, unknown ones skipped."""
    table = F.map_from_arrays(F.array(*map(F.lit, advances)), F.array(*[F.lit(float(v)) for v in advances.values()]))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(table, c), F.lit(0.0))) * size


def glyph_pens(text: Column, advances: dict[str, float], x: Column, size: Column) -> Column:
    """Array of (ch, pen): where each known character of a line starts."""
    table = F.map_from_arrays(F.array(*map(F.lit, advances)), F.array(*[F.lit(float(v)) for v in advances.values()]))
    known = F.filter(F.split(text, ""), lambda c: F.try_element_at(table, c).isNotNull())

    def step(s: Column, c: Column) -> Column:
        return F.struct(F.concat(s["out"], F.array(F.struct(c.alias("ch"), s["pen"].alias("pen")))).alias("out"), (s["pen"] + F.try_element_at(table, c) * size).alias("pen"))

    start = F.struct(F.array().cast("array<struct<ch:string,pen:double>>").alias("out"), x.cast("double").alias("pen"))
    return F.aggregate(known, start, step, lambda s: s["out"])
