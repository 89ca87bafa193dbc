"""Packages: resuming level by level, carved manifests, limits, rasters."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tilewright.operators import mesh, pyramid
from tilewright.plans import commands
from tilewright.sources import tilefile


def tiles(spark, level, size=20):
    at = spark.range(3).select(F.lit(level).alias("z"), F.col("id").cast("int").alias("x"), F.lit(1).alias("y"))
    return at.withColumns({"path": F.concat_ws("/", F.lit(level), "x", F.lit("1.mt2")), "content": F.expr(f"cast(repeat('x', {size}) as binary)")})


def test_a_finished_level_is_not_built_again(spark, tmp_path):
    folder, built = str(tmp_path / "package"), []

    def make(level):
        built.append(level)
        if level == 3 and built.count(3) == 1:
            raise RuntimeError("lost")
        return tiles(spark, level)

    with pytest.raises(RuntimeError):
        commands.build_levels(spark, folder, [2, 3, 4], make)
    out = commands.build_levels(spark, folder, [2, 3, 4], make)
    assert built == [2, 3, 3, 4]
    assert {(r.level, r.resumed) for r in out.collect()} == {(2, True), (3, False), (4, False)} and out.count() == 9
    # A record whose paths are no tiles of the level is not trusted.
    out.limit(1).select(F.lit("4/../x").alias("path"), "digest", "bytes").write.mode("overwrite").parquet(commands.record_path(folder, 4))
    commands.build_levels(spark, folder, [2, 3, 4], make)
    assert built == [2, 3, 3, 4, 4]


def test_a_tile_may_not_be_larger_than_the_limit(spark, tmp_path):
    with pytest.raises(Exception, match="a tile may have"):
        tilefile.written(tiles(spark, 2, tilefile.TILE_BYTES + 1), str(tmp_path)).collect()


def test_carved_manifest_keeps_the_sources(spark):
    t = spark.createDataFrame([(5, 3, 4, "d1", 2, True), (6, 7, 8, "d2", 1, False)], "z int, x long, y long, digest string, features long, has_heights boolean")
    source = pyramid.manifest(t, [{"name": "a", "licence": "b"}], version=4).first()["manifest"]
    carved = json.loads(pyramid.carved_manifest(t.where("z = 5"), source, 1.5, 2.5).first()["manifest"])
    assert carved["view"] == {"lon": 1.5, "lat": 2.5, "zoom": 5} and carved["carved_from"] == json.loads(source)["package_sha256"]
    assert carved["sources"] == [{"name": "a", "licence": "b"}] and carved["format_version"] == 4
    assert carved["tiles"] == ["5/3/4.mt2"] and carved["feature_count"] == 2 and list(carved["bounds"]) == ["5"]


def test_listed_packages_cover_their_list(spark):
    asked = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 1, 1), (2, 0, 0)], "z int, x long, y long")
    listed = spark.createDataFrame([("1/0/0.mt2",), ("2/0/0.mt2",), ("2/0/0.mt2",)], "path string")
    absent = spark.createDataFrame([("2/0/0.mt2",)], "path string")
    boxes = spark.createDataFrame([], "z int, west double, north double, east double, south double")
    assert sorted(map(tuple, pyramid.covers(asked, boxes, listed, absent).collect())) == [(1, 0, 0, True), (1, 0, 0, True), (1, 1, 1, False), (2, 0, 0, False)]
    assert not any(r.covered for r in pyramid.covers(asked, boxes).collect())


def test_material_ranges(spark):
    rows = [(0, 1, "b"), (0, 2, "a"), (0, 3, "b"), (0, 3, "b"), (0, 4, None), (1, 5, "a")]
    got = mesh.material_ranges(spark.createDataFrame(rows, "tile int, id int, material string"), ("tile",), "id").collect()
    assert sorted((r.tile, r.first, r.n, r.material) for r in got) == [(0, 0, 1, None), (0, 1, 1, "a"), (0, 2, 3, "b"), (1, 0, 1, "a")]


def test_resampling_by_blocks_equals_whole_grids(spark):
    from tilewright.functions import grid
    from tilewright.operators import raster

    rows = [(1, 0, -90.0, -40.0, 90.0, 60.0, 37, 23, [float(k % 8000) for k in range(37 * 23)]), (2, 1, 0.0, 0.0, 45.0, 45.0, 1, 1, [5.0])]
    grids = spark.createDataFrame(rows, "grid_id int, ordinal int, west double, south double, east double, north double, width int, height int, samples array<float>")
    at = spark.createDataFrame([(3, 4, 3, 1), (3, 3, 4, 1), (4, 9, 7, 2), (4, 9, 6, None)], "z int, x int, y int, grid_id int")
    got = {tuple(r)[:5]: r.stored for r in raster.resampled(at, grids, block=50).collect()}
    assert len(got) == 3 * raster.SIDE**2
    whole = at.withColumn("i", F.explode(F.array(*map(F.lit, (0, 1, 100, 255))))).withColumn("j", F.explode(F.array(*map(F.lit, (0, 77, 255)))))
    place = lambda c: raster.raster_coord(F.col(c))
    lon, lat = grid.lon_at(F.col("z"), F.col("x").cast("long"), place("j")), grid.lat_at(F.col("z"), F.col("y").cast("long"), place("i"))
    one = whole.join(grids.select("grid_id", F.struct("west", "south", "east", "north", "width", "height", "samples").alias("g")), "grid_id")
    want = one.select("z", "x", "y", "i", "j", grid.encode_height(raster.sample(F.col("g"), lon, lat).cast("double")).alias("stored")).collect()
    assert len(want) == 36 and all(got[tuple(r)[:5]] == r.stored for r in want)
