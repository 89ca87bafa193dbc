"""Queries over vertex lists, rasters, labels and spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import assembly, mesh, parts, placement, raster, rollup
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


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice"


def _ways(spark, sf_dir):
    """One way per order: vertices by line number, x and y from part and supplier keys."""
    li = i.table(spark, sf_dir, "lineitem")
    v = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    held = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(v)).alias("v"))
    xy = F.transform("v", lambda p: F.struct((p["l_partkey"] * 31 % 65536).cast("int").alias("x"), (p["l_suppkey"] * 641 % 65536).cast("int").alias("y")))
    return held.select("l_orderkey", xy.alias("v"))


_WAYS = f"(SELECT l_orderkey, row_number() OVER w AS pos, CAST(l_partkey * 31 % 65536 AS INTEGER) AS x, CAST(l_suppkey * 641 % 65536 AS INTEGER) AS y, lag(CAST(l_partkey * 31 % 65536 AS INTEGER)) OVER w AS px, lag(CAST(l_suppkey * 641 % 65536 AS INTEGER)) OVER w AS py FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDER}))"


@query(f"SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, x, y, x - coalesce(px, 0) AS dx, y - coalesce(py, 0) AS dy FROM {_WAYS}")
def delta_code(spark, sf_dir):
    """Vertices and their deltas."""
    w = _ways(spark, sf_dir).withColumn("d", arrays.deltas(F.col("v")))
    z = w.select("l_orderkey", F.posexplode(F.arrays_zip("v", "d")).alias("pos", "p"))
    return z.select("l_orderkey", (F.col("pos") + 1).alias("pos"), "p.v.x", "p.v.y", F.col("p.d.x").alias("dx"), F.col("p.d.y").alias("dy"))


@query(f"SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, x, y FROM {_WAYS}")
def delta_decode(spark, sf_dir):
    """Vertices back from deltas."""
    w = _ways(spark, sf_dir).select("l_orderkey", F.posexplode(arrays.undeltas(arrays.deltas(F.col("v")))).alias("pos", "p"))
    return w.select("l_orderkey", (F.col("pos") + 1).alias("pos"), "p.x", "p.y")


@query(f"""
SELECT l_orderkey, count(*) AS vertices, round(coalesce(sum(sqrt(power(CAST(x - px AS DOUBLE), 2) + power(CAST(y - py AS DOUBLE), 2))), 0), 3) AS length,
  CAST(count(*) FILTER (px IS NULL OR x <> px OR y <> py) AS INTEGER) AS distinct_steps FROM {_WAYS} GROUP BY l_orderkey""")
def arc_length(spark, sf_dir):
    v = F.col("v")
    return _ways(spark, sf_dir).select("l_orderkey", F.size(v).cast("long").alias("vertices"), F.round(arrays.arc_length(v), 3).alias("length"), F.size(arrays.deduplicated(v)).alias("distinct_steps"))


@query(f"""
WITH s AS (SELECT *, sqrt(power(CAST(x - px AS DOUBLE), 2) + power(CAST(y - py AS DOUBLE), 2)) AS d FROM {_WAYS}),
c AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY l_orderkey ORDER BY pos), 0) AS upto, sum(d) OVER (PARTITION BY l_orderkey) / 2 AS half FROM s),
h AS (SELECT l_orderkey, min(pos) AS pos FROM c WHERE d > 0 AND upto >= half GROUP BY l_orderkey),
e AS (SELECT l_orderkey, arg_max(x, pos) AS x, arg_max(y, pos) AS y FROM c GROUP BY l_orderkey)
SELECT e.l_orderkey, coalesce(round(round(c.px + (c.x - c.px) * ((half - (upto - d)) / d), 6), 0), e.x) AS mx, coalesce(round(round(c.py + (c.y - c.py) * ((half - (upto - d)) / d), 6), 0), e.y) AS my
FROM e LEFT JOIN h USING (l_orderkey) LEFT JOIN c ON c.l_orderkey = h.l_orderkey AND c.pos = h.pos""")
def road_midpoint(spark, sf_dir):
    """The rounded point half-way along each way."""
    p = arrays.midpoint(F.col("v"))
    return _ways(spark, sf_dir).select("l_orderkey", p["x"].alias("mx"), p["y"].alias("my"))


@query(f"""
SELECT l_orderkey, round(sum(CAST(px AS DOUBLE) * y - CAST(x AS DOUBLE) * py) / 2.0, 1) AS area FROM (
  SELECT l_orderkey, x, y, coalesce(px, last_x) AS px, coalesce(py, last_y) AS py FROM (SELECT *, last_value(x) OVER f AS last_x, last_value(y) OVER f AS last_y FROM {_WAYS} WINDOW f AS (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) GROUP BY l_orderkey""")
def ring_area(spark, sf_dir):
    """Signed shoelace area of each way as a ring."""
    return _ways(spark, sf_dir).select("l_orderkey", F.round(arrays.signed_area(F.transform("v", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))), 1).alias("area"))


@query(f"""
WITH e AS (SELECT l_orderkey, CAST(x AS DOUBLE) AS bx, CAST(y AS DOUBLE) AS by_, CAST(coalesce(px, last_x) AS DOUBLE) AS ax, CAST(coalesce(py, last_y) AS DOUBLE) AS ay FROM (SELECT *, last_value(x) OVER f AS last_x, last_value(y) OVER f AS last_y FROM {_WAYS} WINDOW f AS (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
SELECT l_orderkey, count(*) FILTER (CASE WHEN (ay > 32000.5) <> (by_ > 32000.5) THEN 32000.5 < (bx - ax) * (32000.5 - ay) / (by_ - ay) + ax ELSE false END) % 2 = 1 AS inside FROM e GROUP BY l_orderkey""")
def point_in_ring(spark, sf_dir):
    """Whether the middle of the tile lies inside each way as a closed ring."""
    ring = F.transform(F.concat("v", F.slice("v", 1, 1)), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return _ways(spark, sf_dir).select("l_orderkey", ring.alias("r")).select("l_orderkey", arrays.contains(F.col("r"), F.lit(32000.5), F.lit(32000.5)).alias("inside"))


@query("""
SELECT p_partkey, CASE WHEN n >= 0 THEN n * 2 ELSE -n * 2 - 1 END AS zigzag, CASE WHEN (CASE WHEN n >= 0 THEN n * 2 ELSE -n * 2 - 1 END) < 128 THEN 1 WHEN (CASE WHEN n >= 0 THEN n * 2 ELSE -n * 2 - 1 END) < 16384 THEN 2 ELSE 3 END AS bytes
FROM (SELECT p_partkey, CAST(p_partkey * 97 % 40000 - 20000 AS BIGINT) AS n FROM part)""")
def varint_sizes(spark, sf_dir):
    n = (F.col("p_partkey") * 97 % 40000 - 20000).cast("long")
    z = arrays.zigzag(n)
    return i.table(spark, sf_dir, "part").select("p_partkey", z.alias("zigzag"), arrays.varint_size(z).alias("bytes"))


@query("""
WITH m AS (SELECT DISTINCT o_custkey % 40 AS relation, o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 40 < 20)
SELECT o.o_orderkey AS id, o_orderkey % 5 = 0 AS classified FROM orders AS o WHERE o_orderkey % 5 = 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.id = o.o_orderkey)""")
def member_suppression(spark, sf_dir):
    """Orders as ways, customers as relations: ways that classify and that no kept relation holds."""
    o = i.table(spark, sf_dir, "orders")
    road = F.create_map(F.lit("highway"), F.lit("primary"))
    ways = o.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_orderkey")).alias("nodes"), F.when(F.col("o_orderkey") % 5 == 0, road).otherwise(F.create_map(F.lit("x"), F.lit("y"))).alias("tags"))
    member = F.struct(F.lit("way").alias("kind"), F.col("o_orderkey").alias("ref"), F.lit("outer").alias("role"))
    rel = o.where("o_orderkey % 3 = 0").groupBy((F.col("o_custkey") % 40).alias("id")).agg(F.collect_list(member).alias("members"))
    rel = rel.withColumn("tags", F.when(F.col("id") < 20, F.create_map(F.lit("natural"), F.lit("water"))).otherwise(F.create_map(F.lit("x"), F.lit("y"))))
    kept = assembly.kept_relations(rel)
    return assembly.own_ways(assembly.kept_ways(ways, kept)).select("id", F.col("class").isNotNull().alias("classified"))


@query(f"SELECT l_orderkey AS id, CAST(pos AS INTEGER) AS pos, l_partkey AS node, (l_partkey * 7919 % 359999) / 1000.0 - 180.0 AS lon FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS pos FROM lineitem)")
def way_vertices(spark, sf_dir):
    """Node ids of ways resolved to coordinates in node order."""
    li = i.table(spark, sf_dir, "lineitem")
    v = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    ways = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(v)), lambda p: p["l_partkey"]).alias("nodes"))
    nodes = i.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), i.lon_of(F.col("p_partkey")).alias("lon"), i.lat_of(F.col("p_partkey")).alias("lat"))
    at = assembly.located(ways, assembly.referenced(nodes, ways))
    z = at.select("id", F.posexplode(F.arrays_zip("nodes", "vertices")).alias("pos", "p"))
    return z.select("id", (F.col("pos") + 1).alias("pos"), F.col("p.nodes").alias("node"), F.col("p.vertices.lon").alias("lon"))


def _features(spark, sf_dir):
    """Lines, rings and points around the world from orders; every fifth ring has a hole."""
    k = F.col("o_orderkey")
    lon, lat = i.lon_of(k), F.least(F.greatest(i.lat_of(k), F.lit(-70.0)), F.lit(70.0))
    at = lambda dx, dy: F.struct((lon + dx).alias("lon"), (lat + dy).alias("lat"))
    ring = lambda r: F.array(at(0, 0), at(r, 0), at(r, r), at(0, r), at(0, 0))
    line = F.array(at(0, 0), at(0.4, 0.1), at(0.8, 0.1), at(1.2, 0.9))
    nothing = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    hole = F.array(F.array(at(0.3, 0.3), at(0.6, 0.3), at(0.6, 0.6), at(0.3, 0.6), at(0.3, 0.3)))
    kind = k % 4
    tag = lambda a, b: F.create_map(F.lit(a), F.lit(b))
    # The keys of a file that is read as one part are dealt to all cores; what is made of them is many times as large.
    keys = i.table(spark, sf_dir, "orders").select("o_orderkey").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    return keys.select(
        k.alias("id"),
        F.when(kind == 0, tag("highway", "primary")).when(kind == 1, tag("natural", "water")).when(kind == 2, tag("leisure", "park")).otherwise(tag("place", "city")).alias("tags"),
        F.when(kind == 0, line).when(kind == 3, F.array(at(0, 0))).otherwise(ring(1.0)).alias("vertices"),
        F.when(kind.isin(1, 2) & (k % 5 == 0), hole).otherwise(nothing).alias("holes"),
    )


@query(None)
def clip_parts(spark, sf_dir):
    """Features cut into tiles at two levels; tests check the kernels and that rings keep their area."""
    return parts.parts(_features(spark, sf_dir), [5, 8]).groupBy("z", "class").agg(F.count("*").alias("parts"), F.sum(F.size("vertices")).alias("vertices"), F.sum(F.size("holes")).alias("holes"))


_REACH = "CASE o_orderkey % 4 WHEN 0 THEN [1.2, 0.9] WHEN 3 THEN [0.0, 0.0] ELSE [1.0, 1.0] END"


@query(f"""
WITH f AS (SELECT o_orderkey AS id, (o_orderkey * 7919 % 359999) / 1000.0 - 180.0 AS lon, least(greatest((o_orderkey * 104729 % 169999) / 1000.0 - 85.0, -70.0), 70.0) AS lat, {_REACH} AS d FROM orders),
t AS (SELECT id, {i.sql_tile(i.sql_mx('lon'), '5')} AS x, {i.sql_tile(i.sql_my('lat'), '5')} AS y, {i.sql_tile(i.sql_mx('(lon + d[1])'), '5')} AS x1, {i.sql_tile(i.sql_my('(lat + d[2])'), '5')} AS y1 FROM f)
SELECT id, 5 AS z, x, y FROM t WHERE x = x1 AND y = y1""")
def one_tile_features(spark, sf_dir):
    """Features whose vertices all lie in one tile at level 5."""
    return parts.one_tile(_features(spark, sf_dir), 5).select("id", "z", "x", "y")


# Rasters.
def _grids(spark, sf_dir):
    """A 32 x 16 grid per nation row of twelve degrees, samples from arithmetic."""
    n = F.col("n_nationkey")
    west, south = (n % 6) * F.lit(60.0) - 180.0, F.floor(n / 6) * F.lit(30.0) - 60.0
    s = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda c: ((c * 37 + n * 101) % 4000 - 500).cast("float"))
    return i.table(spark, sf_dir, "nation").select(n.alias("grid_id"), n.alias("ordinal"), west.alias("west"), south.alias("south"), (west + 60.0).alias("east"), (south + 30.0).alias("north"), F.lit(32).alias("width"), F.lit(16).alias("height"), s.alias("samples"))


@query("""
WITH g AS (SELECT n_nationkey AS grid_id, (n_nationkey % 6) * 60.0 - 180.0 AS west, (n_nationkey // 6) * 30.0 - 60.0 AS south FROM nation),
p AS (SELECT s_suppkey, (s_suppkey * 7919 % 359999) / 1000.0 - 180.0 AS lon, (s_suppkey * 104729 % 169999) / 1000.0 - 85.0 AS lat FROM supplier),
h AS (SELECT s_suppkey, grid_id, CAST(floor(least(greatest((lon - west) / 60.0, 0), 1 - 2.220446049250313e-16) * 32) AS INTEGER) AS c, CAST(floor(least(greatest((south + 30.0 - lat) / 30.0, 0), 1 - 2.220446049250313e-16) * 16) AS INTEGER) AS r
  FROM p JOIN g ON lon >= west AND lon < west + 60 AND lat >= south AND lat < south + 30)
SELECT s_suppkey, grid_id, CAST(((r * 32 + c) * 37 + grid_id * 101) % 4000 - 500 AS DOUBLE) AS metres FROM h""")
def height_sample(spark, sf_dir):
    """The nearest cell of the grid that holds each point."""
    k = F.col("s_suppkey")
    p = i.table(spark, sf_dir, "supplier").select("s_suppkey", i.lon_of(k).alias("lon"), i.lat_of(k).alias("lat"))
    g = _grids(spark, sf_dir)
    met = p.join(F.broadcast(g), F.expr("lon >= west and lon < east and lat >= south and lat < north"))  # one grid a nation
    return met.select("s_suppkey", "grid_id", raster.sample(F.struct(*g.columns), F.col("lon"), F.col("lat")).cast("double").alias("metres"))


@query(None)
def height_resample(spark, sf_dir):
    """Sample count, sum and place-weighted sum of each tile's raster of 256 x 256 samples from the first covering grid."""
    t = spark.range(0, 64).select(F.lit(3).alias("z"), (F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    at = raster.covering_grid(t, _grids(spark, sf_dir)).where("grid_id is not null")
    cells = raster.resampled(at, _grids(spark, sf_dir))
    return cells.groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.sum("stored").alias("total"), F.sum(F.col("stored") * (F.col("i") * raster.SIDE + F.col("j"))).alias("weighted"))


def _stored(spark, sf_dir):
    n = F.col("n_nationkey")
    return i.table(spark, sf_dir, "nation").select("n_nationkey", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: (c * 53 + n * 17) % 900 + 11000).alias("r"))


_RASTER = "(SELECT n_nationkey, x, y, ((least(greatest(y, 0), 7) * 8 + least(greatest(x, 0), 7)) * 53 + n_nationkey * 17) % 900 AS m FROM nation, range(-1, 9) AS a(x), range(-1, 9) AS b(y))"


@query(f"""
SELECT c.n_nationkey, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, round((e.m - w.m) / 60.0 * 2.0, 9) AS east, round((n.m - s.m) / 60.0 * 2.0, 9) AS north FROM {_RASTER} AS c
JOIN {_RASTER} AS e ON e.n_nationkey = c.n_nationkey AND e.x = c.x + 1 AND e.y = c.y JOIN {_RASTER} AS w ON w.n_nationkey = c.n_nationkey AND w.x = c.x - 1 AND w.y = c.y
JOIN {_RASTER} AS n ON n.n_nationkey = c.n_nationkey AND n.x = c.x AND n.y = c.y - 1 JOIN {_RASTER} AS s ON s.n_nationkey = c.n_nationkey AND s.x = c.x AND s.y = c.y + 1 WHERE c.x BETWEEN 0 AND 7 AND c.y BETWEEN 0 AND 7""")
def gradient(spark, sf_dir):
    """Central differences at every sample, edges repeated."""
    at = _stored(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(7))))
    g = raster.gradient(F.col("r"), F.col("x"), F.col("y"), F.lit(30.0), F.lit(2.0), 8)
    return at.select("n_nationkey", "x", "y", F.round(g["east"], 9).alias("east"), F.round(g["north"], 9).alias("north"))


@query(f"""
SELECT a.n_nationkey, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST((a.m + (b.m - a.m) * 0.25) + ((c.m + (d.m - c.m) * 0.25) - (a.m + (b.m - a.m) * 0.25)) * 0.75 AS DOUBLE) AS metres FROM {_RASTER} AS a
JOIN {_RASTER} AS b ON b.n_nationkey = a.n_nationkey AND b.x = a.x + 1 AND b.y = a.y JOIN {_RASTER} AS c ON c.n_nationkey = a.n_nationkey AND c.x = a.x AND c.y = a.y + 1 JOIN {_RASTER} AS d ON d.n_nationkey = a.n_nationkey AND d.x = a.x + 1 AND d.y = a.y + 1
WHERE a.x BETWEEN 0 AND 7 AND a.y BETWEEN 0 AND 7""")
def bilinear_height(spark, sf_dir):
    at = _stored(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return at.select("n_nationkey", "x", "y", F.round(raster.bilinear(F.col("r"), F.col("x") + 0.25, F.col("y") + 0.75, 8), 9).alias("metres"))


@query("""
SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, v FROM (SELECT p_partkey // 40 AS row, p_partkey % 40 AS col, p_size AS v FROM part) WHERE row % 4 = 0 AND col % 4 = 0""")
def stride_cells(spark, sf_dir):
    c = i.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 40).alias("row"), (F.col("p_partkey") % 40).alias("col"), F.col("p_size").alias("v"))
    return raster.decimated(c, 4)


@query("""
SELECT CAST((4 - n_nationkey // 5) * 2 + r AS INTEGER) AS row, CAST((n_nationkey % 5) * 3 + c AS INTEGER) AS col, n_nationkey * 100 + r * 10 + c AS v FROM nation, range(0, 2) AS a(r), range(0, 3) AS b(c)""")
def mosaic_cells(spark, sf_dir):
    """Equal grids, five by five, as one."""
    n = F.col("n_nationkey")
    g = i.table(spark, sf_dir, "nation").select(n.alias("grid_id"), ((n % 5) * F.lit(30.0)).alias("west"), (F.floor(n / 5) * F.lit(20.0)).alias("south"), F.lit(3).alias("width"), F.lit(2).alias("height"))
    g = g.withColumns({"east": F.col("west") + 30.0, "north": F.col("south") + 20.0})
    c = g.select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(2))))
    c = c.withColumn("v", (F.col("grid_id") * 100 + F.col("row") * 10 + F.col("col")).cast("long"))
    return raster.mosaic(c, g)


@query("SELECT count(*) AS rasters, true AS same FROM nation")
def height_pack_roundtrip(spark, sf_dir):
    """Rasters packed and unpacked again."""
    n = F.col("n_nationkey")
    value = lambda c: F.unhex(F.format_string("%04x", (c * 7 + n * 13) % 65536))
    raw = F.aggregate(F.sequence(F.lit(0), F.lit(1023)), F.lit("").cast("binary"), lambda a, c: F.concat(a, value(c)))
    r = i.table(spark, sf_dir, "nation").select(raw.alias("before"), raw.alias("raster"))
    back = raster.packed(raster.packed(r, side=32), side=32, back=True)
    return back.agg(F.count("*").alias("rasters"), F.bool_and(F.col("before") == F.col("raster")).alias("same"))


# Labels.
def _candidates(spark, sf_dir):
    k = F.col("p_partkey")
    return i.table(spark, sf_dir, "part").select((k % 4).cast("int").alias("frame_id"), F.lit(12).alias("class"), k.alias("fid"), (F.col("p_size") % 10).cast("int").alias("rank"), F.col("p_brand").alias("text"), (k * 37 % 800).cast("float").alias("ax"), (k * 53 % 600).cast("float").alias("ay"), (F.lit(40) + 12 * (F.col("p_size") % 7)).cast("float").alias("w"), F.lit(14.0).cast("float").alias("h"), (k % 2 == 0).alias("repeats_by_text"))


_BOXES = "(SELECT p_partkey AS id, p_brand AS text, p_partkey * 37 % 800 AS ax, p_partkey * 53 % 600 AS ay, (p_partkey * 37 % 800) - (40 + 12 * (p_size % 7)) / 2.0 AS x0, (p_partkey * 53 % 600) - 7.0 AS y0, (p_partkey * 37 % 800) + (40 + 12 * (p_size % 7)) / 2.0 AS x1, (p_partkey * 53 % 600) + 7.0 AS y1 FROM part)"


@query(f"SELECT a.id AS a, b.id AS b FROM {_BOXES} AS a JOIN {_BOXES} AS b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def box_overlaps(spark, sf_dir):
    return placement.overlaps(placement.boxes(_candidates(spark, sf_dir)), "fid")


@query(f"SELECT a.id AS a, b.id AS b FROM {_BOXES} AS a JOIN {_BOXES} AS b ON a.id < b.id AND a.text = b.text AND sqrt(power(a.ax - b.ax, 2) + power(a.ay - b.ay, 2)) <= 260")
def near_repeats(spark, sf_dir):
    return placement.near_repeats(_candidates(spark, sf_dir), "fid")


@query(None)
def label_selection(spark, sf_dir):
    """Greedy placement of four frames; tests hold it against invariants."""
    return placement.place(_candidates(spark, sf_dir), 800.0, 600.0)


# Spans.
PHASES = ("click", "view")


def _spans(spark, sf_dir):
    return i.table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("ms"), F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("study"), "ts", "user_id")


@query("SELECT event_type AS phase, count(*) AS n, round(sum(value), 2) AS total_ms, round(max(value), 2) AS max_ms, round(quantile_disc(value, 0.95), 2) AS p95_ms FROM events GROUP BY event_type")
def phase_rollup(spark, sf_dir):
    return rollup.phases(_spans(spark, sf_dir))


@query("""
SELECT study, phase, seq, round(ms, 2) AS ms FROM (SELECT user_id % 50 AS study, event_type AS phase, event_id AS seq, value AS ms, row_number() OVER (PARTITION BY user_id % 50 ORDER BY value DESC, event_id) AS r FROM events WHERE event_type IN ('click', 'view')) WHERE r = 1""")
def worst_block(spark, sf_dir):
    return rollup.worst(_spans(spark, sf_dir), ("study",), PHASES).select("study", "phase", "seq", "ms")


@query("""
SELECT study, phase, round(total, 2) AS total_ms FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY total DESC, phase) AS r FROM (SELECT user_id % 50 AS study, event_type AS phase, sum(value) AS total FROM events GROUP BY ALL)) WHERE r = 1""")
def busiest_phase(spark, sf_dir):
    return rollup.busiest(_spans(spark, sf_dir), ("study",), None)


@query("""
SELECT study, seq, CAST(sum(CAST(round(ms * 100) AS BIGINT)) OVER w AS DOUBLE) / (count(*) OVER w * 100.0) AS mean_ms, max(ms) OVER w AS max_ms, quantile_disc(ms, 0.95) OVER w AS p95_ms FROM (SELECT user_id % 50 AS study, event_id AS seq, value AS ms FROM events) WINDOW w AS (PARTITION BY study ORDER BY seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def rolling_frame(spark, sf_dir):
    return rollup.rolling(_spans(spark, sf_dir), "study")


@query("""
WITH w AS (SELECT user_id % 50 AS key, round(max(value), 2) AS ms FROM events GROUP BY ALL)
SELECT key, ms, CASE WHEN ms <= 150 THEN 'ok' WHEN key % 2 = 0 AND ms <= (200 + key) * 1.1 THEN 'known' ELSE 'failed' END AS state FROM w""")
def baseline_regressions(spark, sf_dir):
    w = _spans(spark, sf_dir).groupBy(F.col("study").alias("key")).agg(F.round(F.max("ms"), 2).alias("ms"))
    b = spark.range(0, 50, 2).select(F.col("id").alias("key"), (F.col("id") + 200.0).alias("ms"))
    return rollup.regressions(w, b, 150.0)


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS spans FROM s GROUP BY user_id, k""")
def quiescence_sessions(spark, sf_dir):
    """Runs of events of one user without a quiet stretch of six hours."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rollup.quiet_sessions(_spans(spark, sf_dir), "user_id", "6 hours").select("user_id", us("start").alias("start_us"), us("last").alias("last_us"), "spans")


@query("SELECT study, seq FROM (SELECT user_id % 50 AS study, event_id AS seq, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) AS r FROM events) WHERE r <= 100")
def span_retention(spark, sf_dir):
    return rollup.retained(_spans(spark, sf_dir), "study", 100).select("study", "seq")


@query("""
WITH RECURSIVE t AS (SELECT c_custkey, k, CAST((c_custkey * k) % 3 AS DOUBLE) AS target FROM customer, range(1, 9) AS r(k)),
f AS (SELECT c_custkey, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS a FROM customer UNION ALL
  SELECT f.c_custkey, t.k, CASE WHEN abs(target - (a + (target - a) * 0.25)) < 0.005 THEN target ELSE a + (target - a) * 0.25 END FROM f JOIN t ON t.c_custkey = f.c_custkey AND t.k = f.k + 1)
SELECT c_custkey, round(a, 9) AS alpha FROM f WHERE k = 8""")
def alpha_smoothing(spark, sf_dir):
    """The alpha after eight frames of stepping towards moving targets."""
    targets = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: ((F.col("c_custkey") * k) % 3).cast("double"))
    return i.table(spark, sf_dir, "customer").select("c_custkey", F.round(F.element_at(rollup.smoothed(targets), -1), 9).alias("alpha"))


@query("""
WITH m AS (SELECT p_partkey % 40 AS tile, p_size % 7 AS material, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_size % 7, p_partkey) - 1 AS pos FROM part)
SELECT tile, material, min(pos) AS first, count(*) AS n FROM m GROUP BY ALL""")
def material_ranges(spark, sf_dir):
    """Runs of one material in each tile's buildings."""
    p = i.table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("tile"), "p_partkey", (F.col("p_size") % 7).alias("material"))
    return mesh.material_ranges(p, ("tile",), "p_partkey").select("tile", "material", F.col("first").cast("long").alias("first"), "n")


@query("""
SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal - 500.0), c_custkey) AS r FROM customer) WHERE r <= 6""")
def nearest_slots(spark, sf_dir):
    """The six customers nearest to a balance, the top-k that a live budget keeps."""
    w = Window.partitionBy("c_nationkey").orderBy(F.abs(F.col("c_acctbal") - 500.0), "c_custkey")
    return i.table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w)).where("r <= 6").select("c_nationkey", "c_custkey")


@query("""
WITH b AS (SELECT DISTINCT p_partkey % 300 AS id FROM part WHERE p_size % 3 = 0), a AS (SELECT DISTINCT p_partkey % 300 AS id FROM part WHERE p_size % 5 = 0)
SELECT round(count(*) FILTER (b.id IS NULL OR a.id IS NULL) / CAST(count(b.id) AS DOUBLE), 9) AS churn FROM b FULL JOIN a ON a.id = b.id""")
def label_churn(spark, sf_dir):
    p = i.table(spark, sf_dir, "part").select((F.col("p_partkey") % 300).alias("id"), "p_size")
    return placement.churn(p.where("p_size % 3 = 0"), p.where("p_size % 5 = 0"), ["id"]).select(F.round("churn", 9).alias("churn"))
