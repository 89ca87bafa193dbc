"""Point queries: addresses, classes, eligibility, attributes, units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid, style, tags
from . import inputs as i

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_X, _Y = i.sql_mx("lon"), i.sql_my("lat")
_CENSUS = f"""
SELECT p.event_id, lon, lat, level, {i.sql_class("p.event_id")} AS class, {i.sql_tile(_X, "level")} AS x, {i.sql_tile(_Y, "level")} AS y
FROM {i.SQL_POINTS} AS p, {i.sql_levels()}
"""
_ELIGIBLE = f"""
SELECT c.* FROM ({_CENSUS}) AS c JOIN {i.ENTRY_SQL} ON entry.class = c.class
WHERE level >= entry_zoom AND (c.class <> 'Label' OR 1 <= CASE WHEN level <= 5 THEN 0 WHEN level <= 10 THEN 1 WHEN level <= 13 THEN 2 ELSE 3 END)
"""


def _eligible(spark, sf_dir):
    p = i.points(spark, sf_dir).withColumns({"class": tags.classify(F.col("tags")), "rank": tags.rank(F.col("tags"))}).where("class is not null")
    at = p.withColumn("level", F.explode(F.array(*map(F.lit, i.LEVELS)))).where(tags.eligible(F.col("class"), F.col("rank"), F.col("level")))
    a = grid.locate(F.col("lon"), F.col("lat"), F.col("level"))
    return at.select("event_id", "class", "rank", "level", a["x"].alias("x"), a["y"].alias("y"))


@query(f"SELECT level, x, y, class, count(*) AS features FROM ({_ELIGIBLE}) GROUP BY ALL")
def tile_census(spark, sf_dir):
    """Features by level, tile and class after classification and eligibility."""
    return _eligible(spark, sf_dir).groupBy("level", "x", "y", "class").agg(F.count("*").alias("features"))


@query(f"SELECT level, class, count(*) AS features FROM ({_ELIGIBLE}) GROUP BY ALL")
def eligible_by_level(spark, sf_dir):
    return _eligible(spark, sf_dir).groupBy("level", "class").agg(F.count("*").alias("features"))


@query(f"""
SELECT count(*) AS objects, count(*) FILTER (class LIKE 'Road%') AS roads, count(*) FILTER (class = 'Building') AS buildings, count(*) FILTER (class = 'Water') AS water,
  count(*) FILTER (class = 'Park') AS parks, count(*) FILTER (class = 'Poi') AS pois FROM (SELECT {i.sql_class()} AS class FROM events)""")
def class_summary(spark, sf_dir):
    """Objects scanned and counts by class group; labels, boundaries and unclassified objects count as objects only."""
    c = i.points(spark, sf_dir).select(tags.classify(F.col("tags")).alias("class"))
    of = lambda cond, name: F.count_if(cond).alias(name)
    is_ = lambda n: F.coalesce(F.col("class") == n, F.lit(False))
    return c.agg(F.count("*").alias("objects"), of(F.coalesce(F.startswith(F.col("class"), F.lit("Road")), F.lit(False)), "roads"), of(is_("Building"), "buildings"), of(is_("Water"), "water"), of(is_("Park"), "parks"), of(is_("Poi"), "pois"))


@query(f"""
SELECT event_id, x, y, cx, cy, round((CAST(x AS BIGINT) * 65536 + cx) / ((1 << 12) * 65536.0) * 360.0 - 180.0, 9) AS lon_back, round({i.sql_lat("(CAST(y AS BIGINT) * 65536 + cy) / ((1 << 12) * 65536.0)")}, 9) AS lat_back
FROM (SELECT event_id, {i.sql_tile(_X, "12")} AS x, {i.sql_tile(_Y, "12")} AS y, {i.sql_cell(_X, "12")} AS cx, {i.sql_cell(_Y, "12")} AS cy FROM {i.SQL_POINTS})""")
def grid_address(spark, sf_dir):
    """Exact address at level 12 and the way back."""
    p = i.points(spark, sf_dir)
    a = grid.locate(F.col("lon"), F.col("lat"), 12)
    at = p.select("event_id", *[a[k].alias(k) for k in ("x", "y", "cx", "cy")])
    return at.select("*", F.round(grid.lon_at(12, F.col("x").cast("long"), F.col("cx")), 9).alias("lon_back"), F.round(grid.lat_at(12, F.col("y").cast("long"), F.col("cy")), 9).alias("lat_back"))


@query(f"""
SELECT event_id, round({_X} * power(2.0, zoom) * 256.0, 4) AS px, round({_Y} * power(2.0, zoom) * 256.0, 4) AS py, round(100.0 * power(2.0, zoom) * 256.0 / (40075016.68557849 * cos(radians(lat))), 6) AS px_100m,
  round(40075016.68557849 * cos(radians(lat)) / (4096.0 * 65536.0), 9) AS step_m, round(lon, 6) AS lon_back
FROM (SELECT *, 3.0 + (event_id % 64) / 4.0 AS zoom FROM {i.SQL_POINTS})""")
def world_pixels(spark, sf_dir):
    """World pixels at a fractional zoom, ground metres as screen pixels, the grid step, and the longitude back from pixels."""
    p = i.points(spark, sf_dir).withColumn("zoom", 3.0 + (F.col("event_id") % 64) / 4.0)
    px, py = grid.world_px(F.col("lon"), F.col("lat"), F.col("zoom"))
    lon, _ = grid.lonlat_at_px(px, py, F.col("zoom"))
    metres = grid.metres_to_px(F.lit(100.0), F.col("lat"), F.col("zoom"))
    return p.select("event_id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"), F.round(metres, 6).alias("px_100m"), F.round(grid.step_metres(12, F.col("lat")), 9).alias("step_m"), F.round(lon, 6).alias("lon_back"))


@query(f"""
SELECT event_id, CAST(least(greatest(round((ux - floor(ux)) * 65535.0), 0.0), 65535.0) AS INTEGER) AS qx, CAST(least(greatest(round((uy - floor(uy)) * 65535.0), 0.0), 65535.0) AS INTEGER) AS qy
FROM (SELECT event_id, {_X} * 1024.0 AS ux, {_Y} * 1024.0 AS uy FROM {i.SQL_POINTS})""")
def tile_quantise(spark, sf_dir):
    """Tile units at level 10 quantised on the scale of clipped geometry."""
    ux, uy = grid.tile_units(F.col("lon"), F.col("lat"), 10)
    p = i.points(spark, sf_dir).select("event_id", ux.alias("ux"), uy.alias("uy"))
    return p.select("event_id", grid.quantised(F.col("ux"), F.floor("ux")).alias("qx"), grid.quantised(F.col("uy"), F.floor("uy")).alias("qy"))


@query("SELECT s_suppkey, round(degrees(s_suppkey * 1000.0 / 6378137.0), 9) AS lon, round(degrees(2.0 * atan(exp(s_suppkey * 777.0 / 6378137.0)) - pi() / 2), 9) AS lat FROM supplier")
def mercator_inverse(spark, sf_dir):
    """Spherical Mercator metres back to degrees."""
    s = i.table(spark, sf_dir, "supplier")
    lon, lat = grid.from_mercator_metres(F.col("s_suppkey") * F.lit(1000.0), F.col("s_suppkey") * F.lit(777.0))
    return s.select("s_suppkey", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


_ATTRS = """
SELECT kind, class, CASE WHEN kind = 13 THEN 1 ELSE 3 END AS rank, CASE kind WHEN 0 THEN 2 WHEN 2 THEN 6 ELSE 0 END AS flags,
  CASE kind WHEN 7 THEN 'Explicit' WHEN 8 THEN 'Levels' ELSE 'Default' END AS height_source, CASE kind WHEN 7 THEN 125 WHEN 8 THEN 120 ELSE 90 END AS top,
  CASE kind WHEN 7 THEN 30 WHEN 8 THEN 0 END AS base_dm, CASE kind WHEN 7 THEN 'Hipped' WHEN 8 THEN 'Flat' END AS roof, CASE kind WHEN 7 THEN 'Brick' WHEN 8 THEN 'Metal' END AS material,
  CASE kind WHEN 4 THEN 'side lane' WHEN 12 THEN 'corner cafe' WHEN 13 THEN 'newport' END AS place_name
"""


@query(f"""
WITH a AS ({_ATTRS} FROM (SELECT DISTINCT event_id % 14 AS kind, {i.sql_class()} AS class FROM events))
SELECT kind, class, rank, flags, height_source, base_dm, CASE WHEN class = 'Building' THEN top END AS top_dm, roof, material, place_name, count(*) AS rows FROM events JOIN a ON event_id % 14 = kind GROUP BY ALL""")
def tag_normalise(spark, sf_dir):
    """Rank, flags, height source, building attributes and place name from tags, by kind of tag set."""
    t = F.col("tags")
    p = i.points(spark, sf_dir).select((F.col("event_id") % 14).alias("kind"), "tags", tags.classify(t).alias("class"))
    a = p.select("kind", "class", tags.rank(t).alias("rank"), tags.flags(t).alias("flags"), tags.height(t)["source"].alias("height_source"), tags.building(F.col("class"), t).alias("b"), tags.place_name(tags.tag(t, "name")).alias("place_name"))
    flat = a.select("kind", "class", "rank", "flags", "height_source", "b.base_dm", "b.top_dm", "b.roof", "b.material", "place_name")
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("rows"))


@query("""
SELECT c.code, c.class, c.band, CAST(c.entry AS DOUBLE) AS entry_zoom, c.road_rank, c.is_area, n.customers FROM (VALUES (0, 'Land', 'World', 0, NULL, false), (1, 'Water', 'World', 0, NULL, true), (2, 'Park', 'City', 8, NULL, true), (3, 'Building', 'Micro', 16, NULL, true),
  (4, 'RoadMotorway', 'Region', 5, 6, false), (5, 'RoadTrunk', 'Region', 5, 5, false), (6, 'RoadPrimary', 'City', 8, 4, false), (7, 'RoadSecondary', 'District', 10, 3, false), (8, 'RoadResidential', 'Street', 12, 2, false),
  (9, 'RoadService', 'Address', 14, 1, false), (10, 'RoadPath', 'Address', 14, 0, false), (11, 'Poi', 'Address', 14, NULL, false), (12, 'Label', 'World', 0, NULL, false), (13, 'Boundary', 'World', 0, NULL, false)) AS c(code, class, band, entry, road_rank, is_area)
JOIN (SELECT c_custkey % 14 AS code, count(*) AS customers FROM customer GROUP BY ALL) AS n USING (code)""")
def style_dimension(spark, sf_dir):
    """The style table joined to counts by class code."""
    n = i.table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 14).cast("int").alias("code")).agg(F.count("*").alias("customers"))
    return n.join(F.broadcast(style.classes(spark)), "code").select("code", F.col("name").alias("class"), "band", "entry_zoom", "road_rank", "is_area", "customers")  # fourteen rows


@query("""
WITH p AS (SELECT event_id, (event_id % 80) / 4.0 AS zoom FROM events)
SELECT event_id, round(CASE WHEN zoom <= 5 THEN 1.5 WHEN zoom <= 10 THEN 1.5 + 1.5 * (zoom - 5) / 5 WHEN zoom <= 14 THEN 3.0 + 3.0 * (zoom - 10) / 4 WHEN zoom <= 18 THEN 6.0 + 8.0 * (zoom - 14) / 4 ELSE 14.0 END, 9) AS motorway_px,
  round(CASE WHEN zoom <= 14 THEN 0.6 WHEN zoom <= 18 THEN 0.6 + (2.0 - 0.6) * (zoom - 14) / 4 ELSE 2.0 END, 9) AS path_px, round(least(greatest((zoom - 8) / 0.5, 0), 1), 9) AS park_alpha,
  CASE WHEN zoom >= 16 THEN 'Micro' WHEN zoom >= 14 THEN 'Address' WHEN zoom >= 12 THEN 'Street' WHEN zoom >= 10 THEN 'District' WHEN zoom >= 8 THEN 'City' WHEN zoom >= 5 THEN 'Region' ELSE 'World' END AS band,
  CASE WHEN zoom >= 19 THEN 'full' WHEN zoom >= 17 THEN 'simplified' ELSE 'footprint' END AS lod,
  round(1.0 - least(greatest(zoom - 3.5, 0), 1) * least(greatest(zoom - 3.5, 0), 1) * (3.0 - 2.0 * least(greatest(zoom - 3.5, 0), 1)), 9) AS globeness FROM p""")
def zoom_ramps(spark, sf_dir):
    """Road widths, class alpha, band, building detail and globeness by zoom."""
    z = F.col("zoom")
    p = i.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 80) / 4.0).alias("zoom"))
    width = lambda c: F.round(style.road_width(F.lit(c), z), 9)
    return p.select("event_id", width("RoadMotorway").alias("motorway_px"), width("RoadPath").alias("path_px"), F.round(style.class_alpha(F.lit("Park"), z), 9).alias("park_alpha"), style.band_at(z).alias("band"), style.building_lod(z).alias("lod"), F.round(grid.globeness(z), 9).alias("globeness"))


@query("""
WITH p AS (SELECT p_partkey, (p_partkey * 37 % 5000) - 500 AS m FROM part),
t AS (SELECT p_partkey, m, CASE WHEN m <= 0 THEN 0 WHEN m <= 400 THEN m / 400.0 WHEN m <= 1200 THEN 1 + (m - 400) / 800.0 WHEN m <= 2400 THEN 2 + (m - 1200) / 1200.0 WHEN m <= 3600 THEN 3 + (m - 2400) / 1200.0 ELSE 4 END AS u FROM p),
s AS (SELECT *, CAST(least(floor(u), 3) AS INTEGER) AS k FROM t),
c AS (SELECT *, [222, 236, 230, 220, 245] AS r, [234, 232, 216, 200, 243] AS g, [214, 206, 188, 176, 241] AS b FROM s)
SELECT p_partkey, CAST(round(r[k + 1] + (r[k + 2] - r[k + 1]) * (u - k)) AS INTEGER) AS red, CAST(round(g[k + 1] + (g[k + 2] - g[k + 1]) * (u - k)) AS INTEGER) AS green, CAST(round(b[k + 1] + (b[k + 2] - b[k + 1]) * (u - k)) AS INTEGER) AS blue,
  CAST(least(greatest(round(m + 11000.0), 0), 65535) AS INTEGER) AS stored, round(1.0 + 29.0 * least(greatest(p_partkey % 13 / 10.0, 0), 1), 9) AS z_factor FROM c""")
def relief_tint(spark, sf_dir):
    """Hypsometric colour, stored height and relief factor."""
    m = ((F.col("p_partkey") * 37) % 5000 - 500).cast("double")
    p = i.table(spark, sf_dir, "part").select("p_partkey", m.alias("m"), style.tint(m).alias("c"))
    return p.select("p_partkey", F.col("c")[0].alias("red"), F.col("c")[1].alias("green"), F.col("c")[2].alias("blue"), grid.encode_height(F.col("m")).alias("stored"), F.round(style.relief_factor((F.col("p_partkey") % 13) / F.lit(10.0)), 9).alias("z_factor"))


@query("""
WITH p AS (SELECT event_id, event_id * 1.5::DOUBLE AS lon, (event_id % 300) - 150::DOUBLE AS lat, (event_id % 50) - 10::DOUBLE AS zoom, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * -7::DOUBLE END AS bearing, (event_id % 90) - 10::DOUBLE AS tilt FROM events)
SELECT event_id, round((lon + 180.0) - 360.0 * floor((lon + 180.0) / 360.0) - 180.0, 6) AS lon, least(greatest(lat, -85.05112877980659::DOUBLE), 85.05112877980659::DOUBLE) AS lat, least(greatest(zoom, 0::DOUBLE), 22::DOUBLE) AS zoom,
  round(CASE WHEN bearing IS NULL THEN 11.0 ELSE bearing - 360.0 * floor(bearing / 360.0) END, 6) AS bearing, least(greatest(tilt, 0::DOUBLE), 60::DOUBLE) AS tilt FROM p""")
def camera_patch(spark, sf_dir):
    """Camera fields after a patch: wrapped, clamped, and kept where the patch is silent."""
    from ..operators import residency

    e = F.col("event_id")
    p = i.table(spark, sf_dir, "events").select("event_id", (e * F.lit(1.5)).alias("lon"), ((e % 300) - F.lit(150.0)).alias("lat"), ((e % 50) - F.lit(10.0)).alias("zoom"), F.when(e % 3 != 0, e * F.lit(-7.0)).alias("bearing"), ((e % 90) - F.lit(10.0)).alias("tilt"))
    c = residency.patched(dict.fromkeys(("lon", "lat", "zoom", "tilt"), F.lit(0.0)) | {"bearing": F.lit(11.0)}, {k: F.col(k) for k in ("lon", "lat", "zoom", "bearing", "tilt")})
    return p.select("event_id", F.round(c["lon"], 6).alias("lon"), c["lat"].alias("lat"), c["zoom"].alias("zoom"), F.round(c["bearing"], 6).alias("bearing"), c["tilt"].alias("tilt"))


_S = "(SELECT s_suppkey, s_nationkey, (s_suppkey * 7919 % 359999) / 1000.0 - 180.0 AS lon1, (s_suppkey * 104729 % 169999) / 1000.0 - 85.0 AS lat1 FROM supplier)"
_N = "(SELECT n_nationkey, n_name, (n_nationkey * 7919 % 359999) / 1000.0 - 180.0 AS lon2, (n_nationkey * 104729 % 169999) / 1000.0 - 85.0 AS lat2 FROM nation)"


@query(f"SELECT s_suppkey, n_name, round(sqrt(power((lon2 - lon1) * cos(radians((lat1 + lat2) / 2.0)) * 111320.0, 2) + power((lat2 - lat1) * 111320.0, 2)), 3) AS metres FROM {_S} JOIN {_N} ON s_nationkey = n_nationkey")
def metres_between_places(spark, sf_dir):
    s = i.table(spark, sf_dir, "supplier").join(i.table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    d = grid.metres_between(i.lon_of(F.col("s_suppkey")), i.lat_of(F.col("s_suppkey")), i.lon_of(F.col("n_nationkey")), i.lat_of(F.col("n_nationkey")))
    return s.select("s_suppkey", "n_name", F.round(d, 3).alias("metres"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 0.0 ELSE (p_partkey * 13 % 9973) / 7.0 END AS m FROM part)
SELECT p_partkey, CASE WHEN m <= 0 THEN 12 ELSE coalesce((SELECT max(z) FROM range(0, 23) AS r(z) WHERE 40075016.68557849 / power(2.0, z) / 255.0 >= m), 0) END::INTEGER AS cap,
  round(power(2.0, greatest(16 - p_partkey % 18, 0)) * 2.0 / 65535.0, 12) AS tolerance FROM p""")
def terrain_cap(spark, sf_dir):
    """Deepest useful terrain level of a source spacing, and the generalisation tolerance of a level."""
    k = F.col("p_partkey")
    m = F.when(k % 50 == 0, F.lit(0.0)).otherwise((k * 13 % 9973) / F.lit(7.0))
    return i.table(spark, sf_dir, "part").select("p_partkey", grid.terrain_cap(m).alias("cap"), F.round(grid.tolerance((k % 18).cast("int")), 12).alias("tolerance"))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_partkey * 31 % 97 AS DOUBLE) AS px, CAST(p_partkey * 17 % 89 AS DOUBLE) AS py, CAST(p_partkey % 7 AS DOUBLE) AS ax, CAST(p_partkey % 11 AS DOUBLE) AS ay, CAST(p_partkey % 7 + p_partkey % 3 * 20 AS DOUBLE) AS bx, CAST(p_partkey % 11 + p_partkey % 3 * 30 AS DOUBLE) AS by_ FROM part),
t AS (SELECT *, CASE WHEN bx = ax AND by_ = ay THEN 0.0 ELSE least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0.0), 1.0) END AS u FROM p)
SELECT p_partkey, round(sqrt(power(px - ax - u * (bx - ax), 2) + power(py - ay - u * (by_ - ay), 2)), 9) AS distance FROM t""")
def segment_distance(spark, sf_dir):
    k = F.col("p_partkey")
    d = lambda c: c.cast("double")
    ax, ay = d(k % 7), d(k % 11)
    distance = grid.segment_distance(d(k * 31 % 97), d(k * 17 % 89), ax, ay, ax + d(k % 3 * 20), ay + d(k % 3 * 30))
    return i.table(spark, sf_dir, "part").select("p_partkey", F.round(distance, 9).alias("distance"))


@query(f"SELECT event_id, tx, ty, round(sqrt(power((lon - 10.0) * cos(radians((lat + 50.0) / 2.0)) * 111320.0, 2) + power((lat - 50.0) * 111320.0, 2)), 2) AS metres FROM (SELECT event_id, lon, lat, {i.sql_tile(_X, '9')} AS tx, {i.sql_tile(_Y, '9')} AS ty FROM {i.SQL_POINTS})")
def sql_functions(spark, sf_dir):
    """The registered SQL functions inside a SQL query."""
    from ..functions import sql

    sql.register(spark)
    i.points(spark, sf_dir).createOrReplaceTempView("tilewright_points")
    return spark.sql("SELECT event_id, tile_x(lon, 9) AS tx, tile_y(lat, 9) AS ty, round(metres_between(10D, 50D, lon, lat), 2) AS metres FROM tilewright_points")
