"""Queries over tile sets: conflation, residency, ancestors, packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid, tags
from ..operators import conflate as conf
from ..operators import pyramid, raster, residency
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


def _tiles(spark, sf_dir, levels=i.LEVELS, where="true"):
    """Distinct tiles of the events' points at some levels."""
    at = i.points(spark, sf_dir).where(where).withColumn("z", F.explode(F.array(*map(F.lit, levels))))
    a = grid.locate(F.col("lon"), F.col("lat"), F.col("z"))
    return at.select("event_id", "z", a["x"].cast("long").alias("x"), a["y"].cast("long").alias("y"))


def _sql_tiles(levels=i.LEVELS, where="true"):
    return f"(SELECT event_id, CAST(level AS INTEGER) AS z, CAST({i.sql_tile(_X, 'level')} AS BIGINT) AS x, CAST({i.sql_tile(_Y, 'level')} AS BIGINT) AS y FROM {i.SQL_POINTS} AS p, {i.sql_levels(levels)} WHERE {where})"


_LON_AT = lambda z, x, c: f"((CAST({x} AS DOUBLE) * 65536 + {c}) / ((CAST(1 AS BIGINT) << {z}) * 65536.0) * 360.0 - 180.0)"
_LAT_AT = lambda z, y, c: i.sql_lat(f"(CAST({y} AS DOUBLE) * 65536 + {c}) / ((CAST(1 AS BIGINT) << {z}) * 65536.0)")


@query(f"SELECT z, round({_LON_AT('z', 'min(x)', 0)}, 9) AS west, round({_LAT_AT('z', 'min(y)', 0)}, 9) AS north, round({_LON_AT('z', 'max(x)', 65535)}, 9) AS east, round({_LAT_AT('z', 'max(y)', 65535)}, 9) AS south FROM {_sql_tiles()} GROUP BY z")
def level_envelope(spark, sf_dir):
    e = pyramid.envelopes(_tiles(spark, sf_dir))
    return e.select("z", *[F.round(c, 9).alias(c) for c in ("west", "north", "east", "south")])


@query(f"""
WITH t AS (SELECT * FROM {_sql_tiles((12, 14, 16))} WHERE z = 12), m AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM t)
SELECT round({_LON_AT('12', '(a + (b - a) // 2)', 32767)}, 9) AS lon, round({_LAT_AT('12', '(c + (d - c) // 2)', 32767)}, 9) AS lat, 12 AS zoom FROM m""")
def package_view(spark, sf_dir):
    v = pyramid.view(_tiles(spark, sf_dir, (12, 14, 16)))
    return v.select(F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "zoom")


# Claims: one per region, precedence and box from its key.
def _claims(spark, sf_dir):
    r = F.col("r_regionkey")
    west, south = r * F.lit(30.0) - 90.0, r * F.lit(12.0) - 40.0
    return i.table(spark, sf_dir, "region").select(r.alias("layer_id"), (r % 3).alias("precedence"), west.alias("west"), south.alias("south"), (west + 60.0).alias("east"), (south + 45.0).alias("north"), (r * 2).alias("min_level"), (r * 2 + 10).alias("max_level"))


_CLAIMS = "(SELECT r_regionkey AS layer_id, r_regionkey % 3 AS precedence, r_regionkey * 30.0 - 90.0 AS west, r_regionkey * 12.0 - 40.0 AS south, r_regionkey * 30.0 - 30.0 AS east, r_regionkey * 12.0 + 5.0 AS north, r_regionkey * 2 AS min_level, r_regionkey * 2 + 10 AS max_level FROM region)"


def _parts(spark, sf_dir):
    k = F.col("c_custkey")
    return i.table(spark, sf_dir, "customer").select(k.alias("part_id"), (k % 5).cast("int").alias("layer_id"), (k % 17).cast("int").alias("level"), i.lon_of(k).alias("lon"), i.lat_of(k).alias("lat"), F.when(k % 2 == 0, "Label").otherwise("RoadTrunk").alias("class"), F.concat(F.lit(" "), F.upper("c_mktsegment")).alias("name"))


_PARTS = "(SELECT c_custkey AS part_id, CAST(c_custkey % 5 AS INTEGER) AS layer_id, CAST(c_custkey % 17 AS INTEGER) AS level, (c_custkey * 7919 % 359999) / 1000.0 - 180.0 AS lon, (c_custkey * 104729 % 169999) / 1000.0 - 85.0 AS lat FROM customer)"


@query(f"""
SELECT p.part_id, p.layer_id, p.level, EXISTS (SELECT 1 FROM {_CLAIMS} AS c WHERE c.precedence > own.precedence AND p.level BETWEEN c.min_level AND c.max_level AND p.lon BETWEEN c.west AND c.east AND p.lat BETWEEN c.south AND c.north) AS covered
FROM {_PARTS} AS p JOIN {_CLAIMS} AS own USING (layer_id)""")
def coverage_rule(spark, sf_dir):
    return conf.covered(_parts(spark, sf_dir), _claims(spark, sf_dir)).select("part_id", "layer_id", "level", "covered")


# Two layers near each other, so that identity matches happen: suppliers name places that customers name again.
def _places(spark, sf_dir):
    c = i.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("part_id"), F.lit(1).alias("layer_id"), F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("k"), F.lit("Label").alias("class"), F.col("c_mktsegment").alias("name"))
    s = i.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("part_id"), F.lit(0).alias("layer_id"), F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("k"), F.lit("Poi").alias("class"), F.element_at(F.array(*map(F.lit, (" building ", "MACHINERY", "Household", "furniture", ""))), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("name"))
    p = c.unionByName(s)
    lon = F.col("n") * F.lit(10.0) - 125.0 + (F.col("k") * 37 % 100) / F.lit(200.0)
    lat = F.col("n") * F.lit(2.0) - 20.0 + (F.col("k") * 53 % 100) / F.lit(200.0)
    return p.select("part_id", "layer_id", F.lit(12).alias("level"), lon.alias("lon"), lat.alias("lat"), "class", "name")


def _peers(spark):
    return spark.createDataFrame([(0, 10, -180.0, -85.0, 180.0, 85.0, 0, 16), (1, 10, -180.0, -85.0, 180.0, 85.0, 0, 16)], "layer_id int, precedence int, west double, south double, east double, north double, min_level int, max_level int")


@query("""
WITH p AS (SELECT c_custkey * 2 AS part_id, 1 AS layer_id, c_nationkey AS n, c_custkey AS k, lower(trim(c_mktsegment)) AS name FROM customer UNION ALL
  SELECT s_suppkey * 2 + 1, 0, s_nationkey, s_suppkey, ['building', 'machinery', 'household', 'furniture', ''][CAST(s_suppkey % 5 AS INTEGER) + 1] FROM supplier),
g AS (SELECT *, n * 10.0 - 125.0 + (k * 37 % 100) / 200.0 AS lon, n * 2.0 - 20.0 + (k * 53 % 100) / 200.0 AS lat FROM p)
SELECT a.part_id, a.layer_id, CASE WHEN a.layer_id = 1 AND EXISTS (SELECT 1 FROM g AS b WHERE b.layer_id = 0 AND b.name = a.name AND b.name <> '' AND
  sqrt(power((a.lon - b.lon) * cos(radians((a.lat + b.lat) / 2.0)) * 111320.0, 2) + power((a.lat - b.lat) * 111320.0, 2)) <= 25000.0) THEN 'matched' ELSE 'kept' END AS fate FROM g AS a""")
def identity_rule(spark, sf_dir):
    return conf.conflate(_places(spark, sf_dir), _peers(spark)).select("part_id", "layer_id", "fate")


def _sql_report() -> str:
    """The layers one after another in order of precedence, r_regionkey % 3, each against what those before it kept."""
    order, steps = sorted(range(5), key=lambda r: (-(r % 3), r)), []
    near = "sqrt(power((a.lon - k.lon) * cos(radians((a.lat + k.lat) / 2.0)) * 111320.0, 2) + power((a.lat - k.lat) * 111320.0, 2)) <= 25000.0"
    for n, layer in enumerate(order):
        before = " UNION ALL ".join(f"SELECT * FROM f{m} WHERE fate = 'kept' AND key IS NOT NULL" for m in range(n))
        match = f"WHEN EXISTS (SELECT 1 FROM ({before}) AS k WHERE k.key = a.key AND k.level = a.level AND {near}) THEN 'matched' " if n else ""
        steps.append(f"f{n} AS (SELECT a.* EXCLUDE (fate), CASE WHEN fate IS NOT NULL THEN fate {match}ELSE 'kept' END AS fate FROM base AS a WHERE layer_id = {layer})")
    every = " UNION ALL ".join(f"SELECT fate FROM f{n}" for n in range(len(order)))
    return f"""
WITH base AS (SELECT p.*, CASE WHEN c_custkey % 2 = 0 THEN nullif(lower(trim(c_mktsegment)), '') END AS key, CASE WHEN NOT p.level BETWEEN own.min_level AND own.max_level THEN 'inactive'
  WHEN EXISTS (SELECT 1 FROM {_CLAIMS} AS c WHERE c.precedence > own.precedence AND p.level BETWEEN c.min_level AND c.max_level AND p.lon BETWEEN c.west AND c.east AND p.lat BETWEEN c.south AND c.north) THEN 'covered' END AS fate
  FROM {_PARTS} AS p JOIN {_CLAIMS} AS own USING (layer_id) JOIN customer ON c_custkey = part_id),
{", ".join(steps)}
SELECT count(*) FILTER (fate = 'kept') AS kept, count(*) FILTER (fate = 'covered') AS covered, count(*) FILTER (fate = 'matched') AS matched FROM ({every})"""


@query(_sql_report())
def conflation_report(spark, sf_dir):
    """Both rules over five layers of three precedences."""
    return conf.report(conf.conflate(_parts(spark, sf_dir), _claims(spark, sf_dir)))


@query(f"SELECT layer_id, precedence, CAST(dense_rank() OVER (ORDER BY precedence DESC) AS INTEGER) AS epoch FROM {_CLAIMS}")
def precedence_epochs(spark, sf_dir):
    return conf.epochs(_claims(spark, sf_dir)).select("layer_id", "precedence", "epoch")


@query(f"SELECT DISTINCT CAST(unnest(range(min_level, max_level + 1)) AS INTEGER) AS level FROM {_CLAIMS}")
def claimed_levels(spark, sf_dir):
    return conf.claimed_levels(_claims(spark, sf_dir)).select(F.col("level").cast("int").alias("level"))


_HELD = f"(SELECT CAST(level AS INTEGER) AS z, CAST({i.sql_tile(_X, 'level')} AS BIGINT) AS x, CAST({i.sql_tile(_Y, 'level')} AS BIGINT) AS y FROM {_PARTS.replace('AS level, (', 'AS lv, (')} AS p, {i.sql_levels((6, 8, 10))})"


@query(f"""
WITH t AS (SELECT DISTINCT z, x, y FROM {_sql_tiles((12,))}), h AS (SELECT DISTINCT z, x, y FROM {_HELD}),
a AS (SELECT t.z, t.x, t.y, t.z - k AS az, t.x >> CAST(k AS INTEGER) AS ax, t.y >> CAST(k AS INTEGER) AS ay FROM t, range(0, 5) AS r(k)),
s AS (SELECT a.z, a.x, a.y, max(az) AS sz FROM a JOIN h ON h.z = az AND h.x = ax AND h.y = ay GROUP BY ALL)
SELECT t.z, t.x, t.y, CAST(sz AS INTEGER) AS sz, round(1.0 / power(2.0, t.z - sz), 9) AS scale, round((t.x - ((t.x >> CAST(t.z - sz AS INTEGER)) << CAST(t.z - sz AS INTEGER))) / power(2.0, t.z - sz), 9) AS offset_x FROM t LEFT JOIN s USING (z, x, y)""")
def ancestor_lookup(spark, sf_dir):
    """The nearest held ancestor of each tile, four levels up at most, and the window of its raster."""
    t = _tiles(spark, sf_dir, (12,)).select("z", "x", "y").distinct()
    held = _parts(spark, sf_dir).select("lon", "lat", F.explode(F.array(*map(F.lit, (6, 8, 10)))).alias("z"))
    a = grid.locate(F.col("lon"), F.col("lat"), F.col("z"))
    held = held.select("z", a["x"].cast("long").alias("x"), a["y"].cast("long").alias("y"))
    return residency.nearest_ancestor(t, held).select("z", "x", "y", F.col("sz").cast("int").alias("sz"), F.round("scale", 9).alias("scale"), F.round("offset_x", 9).alias("offset_x"))


@query("""
WITH b AS (SELECT CAST(z AS INTEGER) AS z, z * 1.5 AS west FROM (VALUES (2), (5), (9), (14)) AS v(z))
SELECT event_id AS key, CAST(event_id % 17 AS INTEGER) AS level, (SELECT max(z) FROM b WHERE z <= event_id % 17) AS z, CASE WHEN event_id % 17 >= 14 THEN 14 WHEN event_id % 17 >= 9 THEN 9 WHEN event_id % 17 >= 5 THEN 5 ELSE 2 END AS target FROM events""")
def level_asof(spark, sf_dir):
    """The box that answers for a level (its own or the nearest coarser), and the source level of a zoom."""
    boxes = spark.createDataFrame([(z, z * 1.5, 0.0, 0.0, 0.0) for z in (2, 5, 9, 14)], "z int, west double, north double, east double, south double")
    asked = i.table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), (F.col("event_id") % 17).cast("int").alias("level"))
    levels = F.array(*[F.lit(z) for z in (2, 5, 9, 14)])
    return residency.level_box(F.broadcast(boxes), asked).select("key", "level", "z", residency.target_level(F.col("level"), levels).alias("target"))


def _cameras(spark, sf_dir):
    """One session per customer."""
    k = F.col("c_custkey")
    return i.table(spark, sf_dir, "customer").select(k.alias("session"), i.lon_of(k).alias("lon"), i.lat_of(k).alias("lat"), (F.lit(1.0) + (k % 9) / 2.0).alias("zoom"), F.lit(1024).alias("width"), F.lit(768).alias("height"))


RESIDENCY_LEVELS = [0, 2, 4, 6]


def _resident(spark, sf_dir):
    """Every session holds the tiles of its user's events, and its own at two levels."""
    k = F.col("c_custkey")
    e = i.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), i.lon_of(F.col("event_id")).alias("lon"), i.lat_of(F.col("event_id")).alias("lat"), F.explode(F.array(*map(F.lit, (0, 2, 4, 6, 7)))).alias("z"))
    own = i.table(spark, sf_dir, "customer").select(k.alias("session"), i.lon_of(k).alias("lon"), i.lat_of(k).alias("lat"), F.explode(F.array(F.lit(2), F.lit(6))).alias("z"))
    at = grid.locate(F.col("lon"), F.col("lat"), F.col("z"))
    return e.unionByName(own).select("session", "z", at["x"].cast("long").alias("x"), at["y"].cast("long").alias("y"))


_SPAN = lambda z: ", ".join(f"CAST(floor({share} * power(2.0, greatest(zoom, {z})) * 256.0 / (power(2.0, greatest(zoom, {z})) * 256.0 / power(2.0, {z})) {sign} {half} / (power(2.0, greatest(zoom, {z})) * 256.0 / power(2.0, {z}))) AS BIGINT) AS {n}" for n, share, sign, half in (("x0", _X, "-", 512.0), ("x1", _X, "+", 512.0), ("y0", _Y, "-", 384.0), ("y1", _Y, "+", 384.0)))


@query(f"""
WITH c AS (SELECT part_id AS session, lon, lat, 1.0 + (part_id % 9) / 2.0 AS zoom FROM {_PARTS}),
p AS (SELECT user_id AS session, lon, lat, level FROM {i.SQL_POINTS} AS q JOIN events USING (event_id), {i.sql_levels((0, 2, 4, 6, 7))} UNION ALL SELECT session, lon, lat, level FROM c, {i.sql_levels((2, 6))}),
h AS (SELECT DISTINCT session, CAST(level AS INTEGER) AS z, CAST({i.sql_tile(_X, "level")} AS BIGINT) AS x, CAST({i.sql_tile(_Y, "level")} AS BIGINT) AS y FROM p WHERE session IN (SELECT session FROM c)),
r AS (SELECT *, CASE WHEN zoom >= 6 THEN 6 WHEN zoom >= 4 THEN 4 WHEN zoom >= 2 THEN 2 ELSE 0 END AS target FROM c),
s AS (SELECT session, zoom, CAST(z AS INTEGER) AS z, CASE WHEN z = target THEN 'target' WHEN z < target THEN 'coarser' ELSE 'next' END AS role, {_SPAN("z")} FROM r, (VALUES (0), (2), (4), (6)) AS v(z) WHERE z <= target + 2),
w AS (SELECT s.session, zoom, role, s.z, x, y, h.session IS NOT NULL AS held FROM (SELECT session, zoom, role, z, x, unnest(range(greatest(y0, 0), least(y1, (1 << z) - 1) + 1)) AS y FROM (SELECT *, unnest(range(greatest(x0, 0), least(x1, (1 << z) - 1) + 1)) AS x FROM s)) AS s LEFT JOIN h USING (session, z, x, y)),
m AS (SELECT session, z, x, y FROM w WHERE role = 'target' AND NOT held),
cov AS (SELECT w.session, w.z, x, y FROM w JOIN (SELECT session, max(z) AS z FROM w WHERE role = 'coarser' AND held GROUP BY session) AS q ON q.session = w.session AND q.z = w.z WHERE role = 'coarser' AND held AND w.session IN (SELECT session FROM m)),
e AS (SELECT session, z, x, y FROM h EXCEPT SELECT h.session, h.z, x, y FROM h JOIN s ON s.session = h.session AND s.z = h.z WHERE x BETWEEN x0 - 1 AND x1 + 1 AND y BETWEEN y0 - 1 AND y1 + 1)
SELECT session, kind, z, x, y FROM (
  SELECT session, 'draw' AS kind, z, x, y FROM w WHERE role = 'target' UNION ALL SELECT session, 'draw', z, x, y FROM cov UNION ALL SELECT session, 'missing', z, x, y FROM m
  UNION ALL SELECT session, 'fallback', z, x, y FROM w WHERE role = 'coarser' AND NOT held UNION ALL SELECT session, 'prefetch', z, x, y FROM w WHERE role = 'next' AND NOT held AND zoom + 4 >= z UNION ALL SELECT session, 'evict', z, x, y FROM e)""")
def residency_plan(spark, sf_dir):
    """Draw, missing, fallback, prefetch and evict of every session."""
    return residency.plan(_cameras(spark, sf_dir), _resident(spark, sf_dir), RESIDENCY_LEVELS)


@query(f"""
SELECT DISTINCT z, x, y FROM {_sql_tiles()} WHERE z <= 5 OR (z BETWEEN 8 AND 12 AND abs(x - {i.sql_tile(i.sql_mx("10.0"), "z")}) <= 40 AND abs(y - {i.sql_tile(i.sql_my("20.0"), "z")}) <= 40)""")
def carve_square(spark, sf_dir):
    t = _tiles(spark, sf_dir).select("z", "x", "y").distinct()
    return pyramid.carve(t, 10.0, 20.0, [(8, 12, 40)], world=5)


def _files(spark, sf_dir):
    k = F.col("page_id")
    path = grid.tile_path(k % 3 + 4, k % 16, F.floor(k / 16))
    return i.table(spark, sf_dir, "pages").select(path.alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"), "page_id")


_FILES = "(SELECT (page_id % 3 + 4) || '/' || (page_id % 16) || '/' || (page_id // 16) || '.mt2' AS path, sha256(coalesce(html, '')) AS digest, page_id FROM pages)"


@query(f"SELECT sha256(string_agg(path || chr(0) || digest || chr(10), '' ORDER BY path)) AS package_sha256, count(*) AS tile_count FROM {_FILES}")
def package_digest(spark, sf_dir):
    return pyramid.package_digest(pyramid.tile_digests(_files(spark, sf_dir)))


@query(f"""
SELECT path, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'changed' ELSE 'same' END AS state FROM {_FILES} WHERE page_id % 13 <> 0 UNION ALL SELECT path, 'extra' FROM {_FILES} WHERE page_id % 13 = 0 AND page_id % 11 <> 0""")
def integrity_diff(spark, sf_dir):
    """Listed digests against files, some of them changed, missing or extra."""
    f = pyramid.tile_digests(_files(spark, sf_dir)).join(_files(spark, sf_dir).select("path", "page_id"), "path")
    want = f.where("page_id % 13 <> 0").select("path", F.when(F.col("page_id") % 7 == 0, F.lit("0")).otherwise(F.col("digest")).alias("digest"))
    return pyramid.integrity(want, f.where("page_id % 11 <> 0"))


@query(f"""
SELECT page_id, regexp_matches(p, '^[0-9]+/[0-9]+/[0-9]+\\.mt2$') AS is_tile, CASE WHEN regexp_matches(p, '^[0-9]+/[0-9]+/[0-9]+\\.mt2$') THEN CAST(split_part(p, '/', 1) AS INTEGER) END AS z
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || path WHEN 1 THEN '../' || path WHEN 2 THEN path || '.bak' ELSE path END AS p FROM {_FILES})""")
def path_safety(spark, sf_dir):
    k = F.col("page_id") % 5
    p = _files(spark, sf_dir).select("page_id", F.when(k == 0, F.concat(F.lit("/"), "path")).when(k == 1, F.concat(F.lit("../"), "path")).when(k == 2, F.concat("path", F.lit(".bak"))).otherwise(F.col("path")).alias("p"))
    return p.select("page_id", F.col("p").rlike(grid.PATH).alias("is_tile"), grid.parse_path(F.col("p"))["z"].alias("z"))


@query(f"""
WITH t AS (SELECT z, x, y, count(*) AS features FROM {_sql_tiles((4, 6))} GROUP BY ALL)
SELECT CAST(sum(features) AS BIGINT) AS feature_count, count(*) AS tile_count, count(*) FILTER (z <= 5) AS height_tile_count, 'MT2' AS format, true AS valid FROM t""")
def manifest_summary(spark, sf_dir):
    """A manifest written as JSON, read back and validated."""
    t = _tiles(spark, sf_dir, (4, 6)).groupBy("z", "x", "y").agg(F.count("*").alias("features"))
    t = t.withColumns({"digest": F.sha2(grid.tile_path(F.col("z"), F.col("x"), F.col("y")), 256), "has_heights": F.col("z") <= 5})
    m = pyramid.manifest(t, [{"name": "events"}]).select(pyramid.parsed_manifest(F.col("manifest")).alias("m"))
    return m.select("m.feature_count", "m.tile_count", "m.height_tile_count", "m.format", pyramid.manifest_valid(F.col("m")).alias("valid"))


@query("""
WITH b AS (SELECT s_suppkey, (s_suppkey * 7919 % 359999) / 1000.0 - 180.0 AS lon, (s_suppkey * 104729 % 140000) / 1000.0 - 70.0 AS lat FROM supplier),
t AS (SELECT s_suppkey, """ + ", ".join(f"CAST(least(greatest(floor({share} * 64.0), 0), 63) AS BIGINT) AS {n}" for n, share in (("x0", i.sql_mx("lon")), ("x1", i.sql_mx("lon + 9.0")), ("y0", i.sql_my("lat + 6.0")), ("y1", i.sql_my("lat")))) + """ FROM b)
SELECT s_suppkey, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM t)""")
def bbox_cover(spark, sf_dir):
    """The tiles of each supplier's box at level 6."""
    k = F.col("s_suppkey")
    lat = (k * 104729 % 140000).cast("double") / 1000.0 - 70.0
    lon = i.lon_of(k)
    edge = lambda v: F.least(F.greatest(F.floor(v * 64.0), F.lit(0)), F.lit(63)).cast("long")
    box = i.table(spark, sf_dir, "supplier").select("s_suppkey", edge(grid.mercator_x(lon)).alias("x0"), edge(grid.mercator_x(lon + 9.0)).alias("x1"), edge(grid.mercator_y(lat + 6.0)).alias("y0"), edge(grid.mercator_y(lat)).alias("y1"))
    return box.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1"))).select("s_suppkey", "x", "y")


@query(f"SELECT z, count(*) AS tiles, CAST(sum(n) AS BIGINT) AS features FROM (SELECT z, x, y, count(*) AS n FROM {_sql_tiles()} GROUP BY ALL) GROUP BY z")
def level_counts(spark, sf_dir):
    """Tiles and features of each level, the numbers behind a package's totals."""
    return _tiles(spark, sf_dir).groupBy("z", "x", "y").agg(F.count("*").alias("n")).groupBy("z").agg(F.count("*").alias("tiles"), F.sum("n").alias("features"))


@query("SELECT place_name, count(*) AS places, min(c_custkey % 4) AS best_rank FROM (SELECT lower(trim(' ' || c_mktsegment || ' ')) AS place_name, c_custkey FROM customer) GROUP BY ALL")
def rank_by_place(spark, sf_dir):
    name = tags.place_name(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    return i.table(spark, sf_dir, "customer").groupBy(name.alias("place_name")).agg(F.count("*").alias("places"), F.min(F.col("c_custkey") % 4).alias("best_rank"))


@query(f"""
WITH a AS (SELECT DISTINCT z, x, y FROM {_sql_tiles((3, 5, 8, 10))}), b AS (SELECT z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {_sql_tiles((5, 8), "event_id % 50 = 0")} GROUP BY z),
n AS (SELECT a.z, a.x, a.y, max(b.z) AS bz FROM a LEFT JOIN b ON b.z <= a.z GROUP BY ALL)
SELECT n.z, n.x, n.y, coalesce(n.x BETWEEN x0 << (n.z - bz) AND ((x1 + 1) << (n.z - bz)) - 1 AND n.y BETWEEN y0 << (n.z - bz) AND ((y1 + 1) << (n.z - bz)) - 1, false) AND (n.x + n.y) % 7 <> 0 AS covered FROM n LEFT JOIN b ON b.z = n.bz""")
def package_covers(spark, sf_dir):
    """Which tiles a package without a list may hold: inside the envelope of their level or the next above, and not known to be absent."""
    asked = _tiles(spark, sf_dir, (3, 5, 8, 10)).select("z", "x", "y").distinct()
    boxes = pyramid.envelopes(_tiles(spark, sf_dir, (5, 8), "event_id % 50 = 0"))
    absent = asked.where("(x + y) % 7 = 0").select(grid.tile_path(F.col("z"), F.col("x"), F.col("y")).alias("path"))
    return pyramid.covers(asked, boxes, absent=absent)


@query(f"""
SELECT r.session, r.z, r.x, r.y, b.labels FROM ({ORACLE_SQL["residency_plan"]}) AS r JOIN (SELECT z, x, y, count(*) AS labels FROM {_sql_tiles((0, 2, 4, 6))} GROUP BY ALL) AS b ON b.z = r.z AND b.x = r.x AND b.y = r.y WHERE r.kind = 'draw'""")
def drawn_buckets(spark, sf_dir):
    """The label buckets of the tiles that each session draws."""
    drawn = residency_plan(spark, sf_dir).where("kind = 'draw'")
    buckets = _tiles(spark, sf_dir, tuple(RESIDENCY_LEVELS)).groupBy("z", "x", "y").agg(F.count("*").alias("labels"))
    return residency.drawn_buckets(drawn, buckets).select("session", "z", "x", "y", "labels")


_CENTRE = ", ".join(f"{i.sql_tile(m, '6')} AS {c}, {i.sql_cell(m, '6')} AS c{c}" for c, m in (("x", _X), ("y", _Y)))


@query(f"""
WITH c AS (SELECT event_id, {_CENTRE} FROM {i.SQL_POINTS} AS p WHERE event_id % 50 = 0),
s AS (SELECT *, CASE WHEN ((x >> 2) + (y >> 2)) % 5 = 0 THEN 2 WHEN ((x >> 4) + (y >> 4)) % 3 <> 0 THEN 4 END AS up FROM c),
w AS (SELECT event_id, x >> up AS sx, y >> up AS sy, (x - ((x >> up) << up) + cx / 65535.0) / (1 << up) * 255.0 AS tx, (y - ((y >> up) << up) + cy / 65535.0) / (1 << up) * 255.0 AS ty FROM s)
SELECT event_id, round(3 * sx + 5 * sy + tx + 2 * ty, 6) AS height FROM w""")
def centre_heights(spark, sf_dir):
    """The height under each camera's centre through the nearest ancestor's raster, whose samples lie on a slope."""
    z, x, y = (F.col(c) for c in "zxy")
    held = spark.range(16 * 16).select(F.lit(4).alias("z"), (F.col("id") % 16).cast("int").alias("x"), F.floor(F.col("id") / 16).cast("int").alias("y")).where("(x + y) % 5 = 0")
    held = held.unionByName(spark.range(16).select(F.lit(2).alias("z"), (F.col("id") % 4).cast("int").alias("x"), F.floor(F.col("id") / 4).cast("int").alias("y")).where("(x + y) % 3 <> 0"))
    side = raster.SIDE
    samples = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: (F.lit(11000) + x * 3 + y * 5 + k % side + F.floor(k / side) * 2).cast("int"))
    cameras = i.points(spark, sf_dir).where("event_id % 50 = 0").select("event_id", "lon", "lat", F.lit(6).alias("level"))
    return raster.centre_heights(cameras, held.withColumn("raster", samples)).select("event_id", F.round("height", 6).alias("height"))
