"""Queries over projections, meshes, scenes and whole builds."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import camera, grid
from ..operators import mesh, parts, placement, pyramid, raster, scenes
from ..sources import tilefile
from ..tables import written
from . import inputs as i
from . import vectors

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_CAMERA = "2.5 + (event_id % 12) / 4.0"


def _sql_projection() -> str:
    t = "least(greatest(zoom - 3.5, 0.0), 1.0)"
    return f"""
WITH p AS (SELECT *, {_CAMERA} AS zoom FROM {i.SQL_POINTS}), g AS (SELECT *, 1.0 - {t} * {t} * (3.0 - 2.0 * {t}) AS g, power(2.0, zoom) * 256.0 AS world FROM p),
f AS (SELECT *, ((lon - 10.0) / 360.0) * world AS dx0, ({i.sql_my("lat")} - {i.sql_my("50.0")}) * world AS dy0, (1.0 - g) + g * cos(radians(50.0)) AS comp, ((1.0 - g) / cos(radians(50.0)) + g) * world / (2.0 * pi()) AS radius, radians(lon) - radians(10.0) AS d, radians(lat) AS phi, radians(50.0) AS phi0 FROM g),
m AS (SELECT *, (1.0 - g) * (CASE WHEN dx0 > world / 2 THEN dx0 - world WHEN dx0 < -world / 2 THEN dx0 + world ELSE dx0 END) * comp + g * cos(phi) * sin(d) * radius AS mx,
  (1.0 - g) * dy0 * comp - g * (cos(phi0) * sin(phi) - sin(phi0) * cos(phi) * cos(d)) * radius AS my, sin(phi0) * sin(phi) + cos(phi0) * cos(phi) * cos(d) AS front FROM f)
SELECT event_id, round(mx * cos(radians(-30.0)) - my * sin(radians(-30.0)), 3) AS px, round(mx * sin(radians(-30.0)) + my * cos(radians(-30.0)), 3) AS py, front * g + (1.0 - g) >= 0 AS visible FROM m"""


def _view():
    return {"lon": F.lit(10.0), "lat": F.lit(50.0), "zoom": F.col("zoom"), "bearing": F.lit(30.0)}


@query(_sql_projection())
def camera_projection(spark, sf_dir):
    """Screen offsets of points through sheet and globe, turned by the bearing, and which side they are on."""
    p = i.points(spark, sf_dir).withColumn("zoom", 2.5 + (F.col("event_id") % 12) / 4.0)
    at = camera.project(F.col("lon"), F.col("lat"), _view())
    return p.select("event_id", F.round(at["x"], 3).alias("px"), F.round(at["y"], 3).alias("py"), (at["front"] >= 0).alias("visible"))


@query("SELECT event_id, round(lon, 5) AS lon_back, round(lat, 5) AS lat_back FROM (SELECT event_id, 10.0 + (event_id % 41 - 20) / 4.0 AS lon, 50.0 + (event_id % 37 - 18) / 4.0 AS lat FROM events)")
def camera_unprojection(spark, sf_dir):
    """Offsets back to the ground where sheet and globe blend."""
    k = F.col("event_id")
    p = i.table(spark, sf_dir, "events").select("event_id", (F.lit(10.0) + (k % 41 - 20) / 4.0).alias("lon"), (F.lit(50.0) + (k % 37 - 18) / 4.0).alias("lat"), (F.lit(3.0) + (k % 12) / 4.0).alias("zoom"))
    at = camera.project(F.col("lon"), F.col("lat"), _view())
    p = p.withColumns({"px": at["x"], "py": at["y"], "c_lon": F.lit(10.0), "c_lat": F.lit(50.0), "bearing": F.lit(30.0)})
    back = camera.unproject(p, "px", "py", {"lon": "c_lon", "lat": "c_lat", "zoom": "zoom", "bearing": "bearing"})
    return back.select("event_id", F.round("lon_at", 5).alias("lon_back"), F.round("lat_at", 5).alias("lat_back"))


@query("""
WITH c AS (SELECT level, class, entry FROM (VALUES ('Label', 0.0), ('Poi', 14.0), ('RoadMotorway', 8.0), ('RoadService', 16.0)) AS k(class, entry), (VALUES (0), (8), (14), (16)) AS l(level))
SELECT level, class, level >= entry AS ready, CASE WHEN class = 'Label' THEN [20.0, 17.0, 15.0, 13.0][least(level, 3) + 1] ELSE 12.0 END::DOUBLE AS size_px, n.customers FROM c, (SELECT count(*) AS customers FROM customer) AS n""")
def label_rules(spark, sf_dir):
    """When names show, and how large."""
    n = i.table(spark, sf_dir, "customer").count()
    k = spark.createDataFrame([(z, c) for z in (0, 8, 14, 16) for c in ("Label", "Poi", "RoadMotorway", "RoadService")], "level int, class string")
    return k.select("level", "class", (F.col("level") >= placement.ready_zoom(F.col("class"))).alias("ready"), placement.size_px(F.col("class"), F.col("level")).alias("size_px"), F.lit(n).cast("long").alias("customers"))


GLYPHS = {chr(c): (c - 64) / 40.0 for c in range(65, 91)}


@query("SELECT n_nationkey, round(coalesce(list_sum(list_transform(list_filter(string_split(n_name, ''), lambda c: c BETWEEN 'A' AND 'Z' AND c <> ''), lambda c: (ord(c) - 64) / 40.0)), 0) * 16.0, 6) AS width FROM nation")
def text_width(spark, sf_dir):
    """Widths of names by a table of advances; characters outside it are skipped."""
    return i.table(spark, sf_dir, "nation").select("n_nationkey", F.round(camera.measured(F.col("n_name"), GLYPHS, F.lit(16.0)), 6).alias("width"))


@query("""
SELECT z, count(*) AS tiles FROM (SELECT DISTINCT z, cx + dx AS x, cy + dy AS y FROM (SELECT level AS z, """ + i.sql_tile(i.sql_mx("-0.3049"), "level") + """ AS cx, """ + i.sql_tile(i.sql_my("51.5149"), "level") + """ AS cy FROM """ + i.sql_levels() + """), range(-1, 2) AS a(dx), range(-1, 2) AS b(dy) WHERE cx + dx BETWEEN 0 AND (1 << z) - 1 AND cy + dy BETWEEN 0 AND (1 << z) - 1) GROUP BY z""")
def scene_coverage(spark, sf_dir):
    """The synthetic pyramid's tiles around its centre."""
    return scenes.coverage(spark).groupBy("z").agg(F.count("*").alias("tiles"))


@query("SELECT CAST(l.i * 16 + p.i * 8 + c.i AS INTEGER) AS ordinal, l.level, p.step, c.class FROM (VALUES (0, 'tunnel'), (1, 'ground'), (2, 'bridge')) AS l(i, level), (VALUES (0, 'casing'), (1, 'fill')) AS p(i, step), (VALUES (0, 'Boundary'), (1, 'RoadPath'), (2, 'RoadService'), (3, 'RoadResidential'), (4, 'RoadSecondary'), (5, 'RoadPrimary'), (6, 'RoadTrunk'), (7, 'RoadMotorway')) AS c(i, class)")
def road_draw_plan(spark, sf_dir):
    return mesh.road_plan(spark)


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(round(i / 8.0 * 65535.0) AS INTEGER) AS x, CAST(round(j / 8.0 * 65535.0) AS INTEGER) AS y FROM range(0, 9) AS a(i), range(0, 9) AS b(j)")
def ground_grid(spark, sf_dir):
    return mesh.ground_vertices(spark, 8)


@query(None)
def mesh_buckets(spark, sf_dir):
    """Fills, ribbons and buildings of the orders' features and a grid of buildings; tests compare areas."""
    p = mesh.cut_pieces(vectors._features(spark, sf_dir), [8]).unionByName(mesh.pieces(scenes.building_grid(spark)))
    return mesh.summed(p).groupBy("kind", "class").agg(F.sum("triangles").alias("triangles"), F.sum("miters").alias("miters"), F.sum("bevels").alias("bevels"))


@query(None)
def tile_roundtrip(spark, sf_dir):
    """Parts encoded as tiles and decoded again: features, vertices and digests of both sides."""
    f = written(parts.parts(vectors._features(spark, sf_dir), [8]), "parts")
    return tilefile.compared(f, written(tilefile.built(f), "tiles"))


@query(None)
def noise_terrain(spark, sf_dir):
    """Noise rasters packed: sizes before and after."""
    r = scenes.noise_heights(scenes.coverage(spark, (3, 5)))
    p = raster.packed(r)
    return r.select("z", "x", "y", F.octet_length("raster").alias("plain")).join(p.select("z", "x", "y", F.octet_length("raster").alias("packed")), ["z", "x", "y"])


@query("""
WITH s AS (SELECT n_nationkey, CAST(((n_nationkey * 37) % 21 - 10) / 10.0 AS DOUBLE) AS e, CAST(((n_nationkey * 53) % 21 - 10) / 10.0 AS DOUBLE) AS n FROM nation),
r AS (SELECT n_nationkey, greatest((-e * (-0.5) - n * 0.5 + sqrt(0.5)) / sqrt(e * e + n * n + 1.0), 0.0) / sqrt(0.5) AS raw FROM s)
SELECT n_nationkey, round(CASE WHEN raw > 1.0 THEN 1.0 + (raw - 1.0) * 0.35 ELSE raw END, 9) AS shade FROM r""")
def hill_shade(spark, sf_dir):
    n = F.col("n_nationkey")
    e, north = ((n * 37) % 21 - 10) / F.lit(10.0), ((n * 53) % 21 - 10) / F.lit(10.0)
    return i.table(spark, sf_dir, "nation").select("n_nationkey", F.round(raster.shade(e, north), 9).alias("shade"))


@query(f"SELECT s_suppkey, round((s_suppkey % 64) / 64.0, 9) AS origin_x, round(1.0 / 64.0, 9) AS span, round(40075016.68557849 * cos(radians((s_suppkey * 104729 % 169999) / 1000.0 - 85.0)) / 64.0 / 255.0, 6) AS texel_m, CAST(round({2 * math.pi}, 6) AS DOUBLE) AS turn FROM supplier")
def tile_frames(spark, sf_dir):
    k = F.col("s_suppkey")
    f = camera.tile_frame(6, k % 64, k % 64)
    return i.table(spark, sf_dir, "supplier").select("s_suppkey", F.round(f["origin_x"], 9).alias("origin_x"), F.round(f["span"], 9).alias("span"), F.round(grid.texel_metres(6, i.lat_of(k)), 6).alias("texel_m"), F.round(F.lit(2 * math.pi), 6).alias("turn"))


@query("SELECT count(*) AS requests, count(*) FILTER (event_id % 9 IN (0, 2, 4)) AS retryable, count(*) FILTER (event_id * 700 > 4194304) AS oversize FROM events")
def request_states(spark, sf_dir):
    """Responses worth a second try, and bodies beyond the tile limit."""
    k = F.col("event_id")
    status = F.when(k % 9 == 0, F.lit(429)).when(k % 9 == 2, F.lit(503)).when(k % 9 != 4, F.lit(200))
    return i.table(spark, sf_dir, "events").agg(F.count("*").alias("requests"), F.count_if(pyramid.retryable(status)).alias("retryable"), F.count_if(k * 700 > tilefile.TILE_BYTES).alias("oversize"))


@query("SELECT array_to_string(list_sort(list_distinct(list_concat([c_custkey % 5, c_custkey % 7], [3, 1]))), ',') AS levels, count(*) AS packages FROM customer GROUP BY ALL")
def merged_levels(spark, sf_dir):
    """Source levels of packages joined into one sorted set."""
    k = F.col("c_custkey")
    from ..operators import residency

    levels = residency.normalised_levels(F.array_union(F.array(k % 5, k % 7), F.array(F.lit(3).cast("long"), F.lit(1).cast("long"))))
    return i.table(spark, sf_dir, "customer").groupBy(F.array_join(levels.cast("array<string>"), ",").alias("levels")).agg(F.count("*").alias("packages"))


@query("""
SELECT count(*) FILTER (wanted AND arrived) AS loaded, count(*) FILTER (arrived AND NOT wanted) AS late, count(*) FILTER (wanted AND NOT arrived) AS unavailable FROM (SELECT p_partkey, p_partkey % 3 = 0 AS wanted, p_size % 2 = 0 AS arrived FROM part)""")
def load_counters(spark, sf_dir):
    """What a demand pass loaded, dropped as late, and could not get."""
    p = i.table(spark, sf_dir, "part").select((F.col("p_partkey") % 3 == 0).alias("wanted"), (F.col("p_size") % 2 == 0).alias("arrived"))
    return p.agg(F.count_if(F.expr("wanted and arrived")).alias("loaded"), F.count_if(F.expr("arrived and not wanted")).alias("late"), F.count_if(F.expr("wanted and not arrived")).alias("unavailable"))
