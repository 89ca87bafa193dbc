"""Whole builds and package commands as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, style, tags
from ..operators import assembly, conflate, parts, pyramid, raster
from ..sources import register, tilefile
from ..sources.osmpbf import tables


def scan(elements: DataFrame) -> DataFrame:
    """One row: objects, and features by class group."""
    c = elements.select(tags.classify(F.col("tags")).alias("c"))
    road = F.coalesce(style.road_rank(F.col("c")).isNotNull(), F.lit(False))
    is_ = lambda n: F.coalesce(F.col("c") == n, F.lit(False))
    return c.agg(F.count("*").alias("objects"), F.count_if(road).alias("roads"), *[F.count_if(is_(n)).alias(a) for n, a in (("Building", "buildings"), ("Water", "water"), ("Park", "parks"), ("Poi", "pois"))])


def resolve(spark: SparkSession, path: str) -> DataFrame:
    """Features (id, tags, vertices, holes) of a PBF file: own ways, kept relations' polygons and point nodes, from one scan."""
    register(spark)
    return assembled(*tables(spark.read.format("osmpbf").option("path", path).load()))


def assembled(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    kept = assembly.kept_relations(relations)
    held = assembly.kept_ways(ways, kept)
    at = assembly.referenced(nodes, held)
    nothing = F.array().cast(f"array<array<{assembly.VERTEX}>>")
    own = assembly.located(assembly.own_ways(held), at).select("id", "tags", "vertices", nothing.alias("holes"))
    shapes = assembly.polygons(kept, held, at).join(kept.select("id", "tags"), "id").select("id", "tags", F.col("outer").alias("vertices"), "holes")
    point = F.array(F.struct("lon", "lat"))
    dots = assembly.point_nodes(nodes).select("id", "tags", point.alias("vertices"), nothing.alias("holes"))
    return own.unionByName(shapes).unionByName(dots)


def build(layers: dict[int, DataFrame], claims: DataFrame, levels: list[int], grids: DataFrame | None = None, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tiles, report) of layers (features by layer id) at all levels in one job graph: parts, conflation, heights, encoding."""
    made = None
    for n, features in layers.items():
        p = parts.parts(features, levels).withColumn("layer_id", F.lit(n))
        made = p if made is None else made.unionByName(p)
    lon, lat = parts.representative(F.col("vertices"), F.col("z"), F.col("x"), F.col("y"))
    key = F.struct("layer_id", "z", "x", "y", "id", "ordinal")
    flat = made.withColumns({"part_id": F.xxhash64(F.to_json(key)), "level": F.col("z"), "lon": lon, "lat": lat})
    fates = conflate.conflate(flat, claims)
    kept = fates.where("fate = 'kept'")
    heights = None
    if grids is not None:
        deep = style_cap(cap)
        tiles = raster.covering_grid(kept.where(F.col("z") <= deep).select("z", "x", "y").distinct(), grids).where("grid_id is not null")
        heights = packed_heights(tiles, grids)
    return tilefile.built(kept, heights), conflate.report(fates)


def record_path(folder: str, level: int) -> str:
    return f"{folder}/.level-{level:02}.done"


def finished_level(spark: SparkSession, folder: str, level: int) -> DataFrame | None:
    """What an earlier run recorded of a level (path, digest, bytes), or None: no record, an unfinished one, or one whose paths
    are no tiles of the level, which is built again rather than trusted."""
    path = record_path(folder, level)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return None
    held = spark.read.parquet(path)
    if set(held.columns) != {"path", "digest", "bytes"}:
        return None
    bad = ~(F.col("path").rlike(grid.PATH) & F.col("path").startswith(f"{level}/")) | F.col("digest").isNull()
    return held if held.where(F.coalesce(bad, F.lit(True))).isEmpty() else None


def build_levels(spark: SparkSession, folder: str, levels: list[int], make) -> DataFrame:
    """(level, path, digest, bytes, resumed) of a package that is written level by level; make(level) gives a level's tiles.

    A level that an earlier run finished is taken from its record beside the tiles, and one that it did not is built again."""
    out = None
    for level in levels:
        held = finished_level(spark, folder, level)
        if held is None:
            tilefile.written(make(level), folder).write.mode("overwrite").parquet(record_path(folder, level))
        own = spark.read.parquet(record_path(folder, level)).select(F.lit(level).alias("level"), "path", "digest", "bytes", F.lit(held is not None).alias("resumed"))
        out = own if out is None else out.unionByName(own)
    return out


def style_cap(cap: int | None) -> int:
    return grid.TERRAIN_MAX_LEVEL if cap is None else cap


def packed_heights(tiles: DataFrame, grids: DataFrame) -> DataFrame:
    """(z, x, y, packed): each tile's raster resampled from its grid."""
    cells = raster.resampled(tiles, grids)
    rows = cells.groupBy("z", "x", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "stored"))), lambda c: c["stored"]).alias("v"))
    both = F.aggregate("v", F.lit("").cast("binary"), lambda a, n: F.concat(a, F.unhex(F.format_string("%02x%02x", n.bitwiseAND(F.lit(255)), F.shiftright(n, 8)))))
    return raster.packed(rows.select("z", "x", "y", both.alias("raster"))).withColumnRenamed("raster", "packed")


def verify_package(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """path and state of every tile against the manifest's digests; a package without them is checked by its package digest."""
    m = spark.createDataFrame([(manifest,)], "t string").select(pyramid.parsed_manifest(F.col("t")).alias("m"))
    actual = pyramid.tile_digests(tilefile.files(spark, folder))
    listed = m.select(F.explode("m.tile_digests").alias("path", "digest"))
    if m.first()["m"]["tile_digests"] is not None:
        return pyramid.integrity(listed, actual)
    want = m.first()["m"]["package_sha256"]
    got = pyramid.package_digest(actual)
    return got.select(F.lit("package").alias("path"), F.when(F.col("package_sha256") == want, "same").otherwise("changed").alias("state"))


def carve_package(spark: SparkSession, folder: str, lon: float, lat: float, rules: list[tuple[int, int, int]], world: int | None = None) -> DataFrame:
    """The files (path, content) of a package that a carve keeps."""
    files = tilefile.files(spark, folder)
    at = grid.parse_path(F.col("path"))
    return pyramid.carve(files.withColumns({k: v for k, v in at.items()}), lon, lat, rules, world).select("path", "content")


def dem_info(grids: DataFrame) -> DataFrame:
    """Size, box and range of each grid."""
    return grids.select("grid_id", "west", "south", "east", "north", "width", "height", F.array_min("samples").alias("low"), F.array_max("samples").alias("high"))


def tile_window(spark: SparkSession, path: str, box: tuple[float, float, float, float], wanted: tuple[float, float, float, float]) -> DataFrame:
    """Chunks of a TIFF that a geographic window meets; chunks outside it are never read."""
    from ..sources import tiff

    register(spark)
    with tiff.opened(path) as source:
        image = tiff.layout(source)
    c0, r0, c1, r1 = raster.window(*wanted, box, image["width"], image["height"])
    return spark.read.format("tiff").options(path=path, col0=c0, row0=r0, col1=c1, row1=r1).load()
