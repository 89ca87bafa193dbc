"""ESRI shapefiles with their DBF attributes as a Python data source, and the layers made of them.

spark.read.format("shp").option("path", ..).load() gives (ordinal, kind, parts, attributes): parts are lists of (x, y), attributes
trimmed texts.  Ids of derived layers are running counters over file order.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import grid
from .osmpbf import opened

SCHEMA = "ordinal long, kind string, parts array<array<struct<x:double,y:double>>>, attributes map<string,string>"
# Shape codes, and the road types that have a counterpart.
POINTS, LINES, POLYGONS = (1, 11, 21), (3, 13, 23), (5, 15, 25)
HIGHWAYS = {"Major Highway": "motorway", "Secondary Highway": "trunk", "Road": "primary", "Beltway": "primary", "Bypass": "primary"}


def shapes(data: bytes):
    """(kind, parts) of each record of a .shp file, null shapes included."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("no shapefile")
    at, end = 100, 2 * struct.unpack_from(">i", data, 24)[0]
    while at + 8 <= min(end, len(data)):
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("truncated shapefile")
        at += 8 + size
        (code,) = struct.unpack_from("<i", body)
        if code in POINTS:
            yield "point", [[struct.unpack_from("<2d", body, 4)]]
        elif code in LINES or code in POLYGONS:
            n, total = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{n}i", body, 44), total]
            flat = struct.unpack_from(f"<{2 * total}d", body, 44 + 4 * n)
            points = list(zip(flat[::2], flat[1::2], strict=True))
            yield "line" if code in LINES else "polygon", [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            yield "null", []


def records(data: bytes):
    """Attributes of each DBF row as trimmed texts; blanks are left out."""
    n, head, width = struct.unpack_from("<IHH", data, 4)
    columns, at = [], 32
    while data[at] != 0x0D:
        columns.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), data[at + 16]))
        at += 32
    for i in range(n):
        row, at, out = data[head + i * width : head + (i + 1) * width], 1, {}
        for name, size in columns:
            value = row[at : at + size].decode("utf-8", "replace").strip(" \0\t\r\n")
            at += size
            if value and set(value) != {"*"}:
                out[name] = value
        yield out


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition):
        with opened(partition.value) as source:
            found = shapes(source.read())
            try:
                with opened(partition.value[:-4] + ".dbf") as table:
                    rows = list(records(table.read()))
            except FileNotFoundError:
                rows = []
        for i, (kind, parts) in enumerate(found):
            yield i, kind, [[tuple(p) for p in part] for part in parts], rows[i] if i < len(rows) else {}


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def _text(name: str):
    return F.nullif(F.trim(F.try_element_at("attributes", F.lit(name))), F.lit(""))


def _number(name: str):
    return _text(name).try_cast("double")


_LONLAT = lambda part: F.transform(part, lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """A running id over file order.  Layer files hold thousands of shapes, so one ordered window is enough."""
    return df.withColumn("id", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _feature(df: DataFrame, tags: dict):
    pairs = [x for k, v in tags.items() for x in (F.lit(k), v)]
    nothing = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    return df.select("id", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("tags"), "vertices", nothing.alias("holes"))


def places(shp: DataFrame) -> DataFrame:
    """Named points as places, by rank of scale; rows without a point or a name do not count."""
    rank = F.coalesce(_number("SCALERANK"), F.lit(10.0))
    kind = F.when(rank <= 1, "city").when(rank <= 4, "town").when(rank <= 7, "village").otherwise("hamlet")
    p = shp.where("kind = 'point'").where(_text("NAME").isNotNull()).withColumn("vertices", _LONLAT(F.col("parts")[0]))
    return _feature(_numbered(p, "ordinal"), {"place": kind, "name": _text("NAME")})


def _lines(shp: DataFrame) -> DataFrame:
    return shp.where("kind = 'line'").select("ordinal", "attributes", F.posexplode(F.filter("parts", lambda p: F.size(p) >= 2)).alias("part", "points")).withColumn("vertices", _LONLAT(F.col("points")))


def boundaries(shp: DataFrame, level: int) -> DataFrame:
    b = _lines(shp.where(F.coalesce(_number("MIN_ZOOM"), F.lit(0.0)) <= level + 1))
    return _feature(_numbered(b, "ordinal", "part"), {"boundary": F.lit("administrative"), "admin_level": F.lit("2")})


def roads(shp: DataFrame, level: int) -> DataFrame:
    kind = F.lit(None).cast("string")
    for said, highway in HIGHWAYS.items():
        kind = F.when(_text("type") == said, F.lit(highway)).otherwise(kind)
    r = _lines(shp.withColumn("attributes", F.col("attributes")).where(kind.isNotNull() & (F.coalesce(_number("scalerank"), F.lit(12.0)) <= level + 2)))
    return _feature(_numbered(r, "ordinal", "part"), {"highway": kind, "name": F.coalesce(_text("label"), _text("name"), F.lit(""))})


def water(shp: DataFrame) -> DataFrame:
    """Outer rings with their holes, from Mercator metres; outer rings run clockwise, and a hole follows its outer ring."""
    from ..functions import arrays

    rings = shp.where("kind = 'polygon'").select("ordinal", F.posexplode("parts").alias("part", "ring")).withColumn("outer", arrays.signed_area(F.col("ring")) <= 0)
    group = F.sum(F.col("outer").cast("int")).over(Window.partitionBy("ordinal").orderBy("part"))
    lon, lat = (lambda p: grid.from_mercator_metres(p["x"], p["y"])[0]), (lambda p: grid.from_mercator_metres(p["x"], p["y"])[1])
    at = rings.withColumn("g", group).where("g > 0").withColumn("v", F.transform("ring", lambda p: F.struct(lon(p).alias("lon"), lat(p).alias("lat"))))
    one = at.groupBy("ordinal", "g").agg(F.max_by("v", "outer").alias("vertices"), F.transform(F.sort_array(F.collect_list(F.when(~F.col("outer"), F.struct("part", "v")))), lambda h: h["v"]).alias("holes"))
    return _numbered(one, "ordinal", "g").select("id", F.create_map(F.lit("natural"), F.lit("water")).alias("tags"), "vertices", "holes")
