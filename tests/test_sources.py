from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import sources
from tilewright.operators import parts, pyramid, raster
from tilewright.sources import descriptors, osmpbf, shapefile, tiff, tilefile


def feature(**more):
    return {"class": 3, "id": 2**40, "flags": 2, "rank": 1, "name": "Ünïon", "vertices": [(0, 0), (65535, 3), (4, 65535), (0, 0)], "holes": [[(1, 1), (2, 1), (2, 2), (1, 1)]], "building": {"base_dm": 3, "top_dm": 90, "roof": "Hipped", "material": "Glass"}} | more


def test_tiles_round_trip_and_damage_is_an_error():
    raw = tilefile.encode(12, 5, 9, [feature(), feature(id=7, building=None, holes=[]), feature(**{"class": 6}, building=None)], {tilefile.HEIGHTS: b"abc"})
    version, tile, found = tilefile.sections(raw)
    assert (version, tile, [c for c, _ in found]) == (6, (12, 5, 9), [3, 6, tilefile.HEIGHTS])
    one, two = tilefile.features(found[0][1], 6)
    assert one == {k: v for k, v in feature().items() if k != "class"}
    assert two["building"] is None and two["id"] == 7
    for cut in range(len(raw)):
        try:
            v, _, s = tilefile.sections(raw[:cut])
            for c, p in s:
                list(tilefile.features(p, v)) if c < tilefile.RASTER_BASE else None
        except tilefile.TileError:
            pass
    for bad in (b"XXXX" + raw[4:], raw[:4] + b"\x09\0" + raw[6:]):
        with pytest.raises(tilefile.TileError):
            tilefile.sections(bad)
    with pytest.raises(tilefile.TileError):
        tilefile.encode(0, 0, 0, [feature(vertices=[])])
    with pytest.raises(tilefile.TileError):
        tilefile.encode(0, 0, 0, [feature(building={"base_dm": 9, "top_dm": 9, "roof": "Flat", "material": "Unknown"})])


def test_older_versions_are_read():
    line = struct.pack("<3H", 1, 4, 5)
    v1 = struct.pack("<H", 1) + struct.pack("<IBBH", 7, 0, 3, 2) + b"ab" + line
    assert next(iter(tilefile.features(v1, 1)))["name"] == "ab"
    v4 = struct.pack("<H", 1) + struct.pack("<QBBHHBH", 2**50, 0, 3, 0, 30, 1, 0) + line + struct.pack("<H", 0)
    assert next(iter(tilefile.features(v4, 4)))["building"]["material"] == "Unknown"


def test_build_write_read_verify_and_carve(spark, tmp_path):
    v = "array<struct<lon:double,lat:double>>"
    f = spark.createDataFrame([(i, {"place": "city", "name": f"P{i}"}, [(i * 7.0 - 100, i * 1.0)], []) for i in range(20)], f"id long, tags map<string,string>, vertices {v}, holes array<{v}>")
    p = parts.parts(f, [0, 5])
    heights = p.select("z", "x", "y").distinct().where("z = 5").withColumn("packed", F.lit(raster.pack((11005).to_bytes(2, "little") * 65536)))
    built = tilefile.built(p, heights)
    done = tilefile.written(built, str(tmp_path / "pkg")).collect()
    files = tilefile.files(spark, str(tmp_path / "pkg"))
    assert pyramid.integrity(spark.createDataFrame([(r.path, r.digest) for r in done], "path string, digest string"), pyramid.tile_digests(files)).where("state <> 'same'").count() == 0
    back = tilefile.decoded(files)
    assert back.where("z = 5").count() == 20 and back.where("z = 0").count() == 20
    assert tilefile.decoded(files, [3]).count() == 0
    assert tilefile.rasters(files).count() == heights.count()
    tiles = back.select("z", "x", "y").distinct()
    assert pyramid.carve(tiles, 0.0, 0.0, [(5, 5, 0)], world=0).where("z = 0").count() == 1
    with pytest.raises(ValueError):
        pyramid.carve(tiles, 0.0, 0.0, [(5, 4, 0)])


def tag(number, kind, value):
    return osm_varint(number << 3 | kind) + (value if kind != 2 else osm_varint(len(value)) + value)


def osm_varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zig(n):
    return osm_varint(n << 1 if n >= 0 else (-n << 1) - 1)


def pbf() -> bytes:
    strings = tag(1, 2, b"") + tag(1, 2, b"highway") + tag(1, 2, b"path") + tag(1, 2, b"outer")
    dense = tag(1, 2, zig(5) + zig(1)) + tag(8, 2, zig(515000000) + zig(10)) + tag(9, 2, zig(-1000000) + zig(10)) + tag(10, 2, b"\1\2\0\0")
    way = tag(1, 0, osm_varint(9)) + tag(2, 2, b"\1") + tag(3, 2, b"\2") + tag(8, 2, zig(5) + zig(1))
    rel = tag(1, 0, osm_varint(3)) + tag(8, 2, b"\3") + tag(9, 2, zig(9)) + tag(10, 2, b"\1")
    block = tag(1, 2, strings) + tag(2, 2, tag(2, 2, dense)) + tag(2, 2, tag(3, 2, way)) + tag(2, 2, tag(4, 2, rel))
    out = b""
    for kind, body in ((b"OSMHeader", b""), (b"OSMData", block), (b"OSMData", block)):
        blob = tag(2, 0, osm_varint(len(body))) + tag(3, 2, zlib.compress(body))
        head = tag(1, 2, kind) + tag(3, 0, osm_varint(len(blob)))
        out += struct.pack(">I", len(head)) + head + blob
    return out


def test_pbf_is_read_by_blobs(spark, tmp_path):
    sources.register(spark)
    (tmp_path / "a.pbf").write_bytes(pbf())
    found = spark.read.format("osmpbf").option("path", str(tmp_path / "a.pbf")).option("blobs", 1).load()
    assert found.rdd.getNumPartitions() == 2
    nodes, ways, relations = osmpbf.tables(found)
    n = nodes.orderBy("id").first()
    assert (n.id, round(n.lat, 4), round(n.lon, 4), n.tags) == (5, 51.5, -0.1, {"highway": "path"})
    assert ways.first().nodes == [5, 6] and relations.first().members[0].role == "outer"
    (tmp_path / "b.pbf").write_bytes(pbf()[:-5])
    with pytest.raises(Exception):  # noqa: B017
        spark.read.format("osmpbf").option("path", str(tmp_path / "b.pbf")).load().collect()


def shp(records) -> bytes:
    body = b"".join(struct.pack(">2i", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 1, *[0.0] * 8) + body


def poly(code, parts_):
    flat = [p for part in parts_ for p in part]
    starts, at = [], 0
    for part in parts_:
        starts.append(at)
        at += len(part)
    return struct.pack("<i4d2i", code, 0, 0, 0, 0, len(parts_), len(flat)) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{2 * len(flat)}d", *[c for p in flat for c in p])


def dbf(columns, rows) -> bytes:
    width = 1 + sum(n for _, n in columns)
    head = b"".join(name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([n]) + b"\0" * 15 for name, n in columns) + b"\r"
    return struct.pack("<B3BIHH20x", 3, 26, 1, 1, len(rows), 32 + len(head), width) + head + b"".join(b" " + b"".join(str(v).encode().ljust(n) for v, (_, n) in zip(r, columns, strict=True)) for r in rows)


def test_shapefiles_become_layers(spark, tmp_path):
    sources.register(spark)
    point = lambda x, y: struct.pack("<i2d", 1, x, y)
    (tmp_path / "p.shp").write_bytes(shp([point(1, 2), point(3, 4), point(5, 6)]))
    (tmp_path / "p.dbf").write_bytes(dbf([("NAME", 10), ("SCALERANK", 6)], [("Oslo", 1), ("", 2), ("Bergen", "")]))
    got = shapefile.places(spark.read.format("shp").option("path", str(tmp_path / "p.shp")).load()).orderBy("id").collect()
    assert [(r.id, r.tags["place"], r.tags["name"]) for r in got] == [(1, "city", "Oslo"), (2, "hamlet", "Bergen")]
    (tmp_path / "l.shp").write_bytes(shp([poly(3, [[(0, 0), (1, 1)], [(2, 2)], [(3, 3), (4, 4)]]), poly(3, [[(0, 0), (9, 9)]])]))
    (tmp_path / "l.dbf").write_bytes(dbf([("type", 20), ("scalerank", 6), ("label", 6), ("name", 6), ("MIN_ZOOM", 6)], [("Road", 3, "", "N1", 2), ("Ferry", 1, "F", "", 9)]))
    lines = spark.read.format("shp").option("path", str(tmp_path / "l.shp")).load()
    r = shapefile.roads(lines, 1).collect()
    assert len(r) == 2 and r[0].tags == {"highway": "primary", "name": "N1"}
    assert shapefile.roads(lines, 0).count() == 0 and shapefile.boundaries(lines, 1).count() == 2 and shapefile.boundaries(lines, 8).count() == 3
    outer = [(0.0, 0.0), (0.0, 100.0), (100.0, 100.0), (100.0, 0.0), (0.0, 0.0)]
    hole = [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 10.0)]
    (tmp_path / "w.shp").write_bytes(shp([poly(5, [outer, hole, outer])]))
    w = shapefile.water(spark.read.format("shp").option("path", str(tmp_path / "w.shp")).load()).orderBy("id").collect()
    assert [(x.id, len(x.holes)) for x in w] == [(1, 1), (2, 0)]


def tif(v: np.ndarray, strip: int, deflate: bool) -> bytes:
    strips = [v[i : i + strip].tobytes() for i in range(0, len(v), strip)]
    strips = [zlib.compress(s) if deflate else s for s in strips]
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    n = len(strips)
    table, extra = [], b""
    for t, kind, count, value in ((256, 3, 1, v.shape[1]), (257, 3, 1, v.shape[0]), (258, 3, 1, 16), (259, 3, 1, 8 if deflate else 1), (273, 4, n, offsets), (278, 3, 1, strip), (279, 4, n, [len(s) for s in strips]), (339, 3, 1, 2)):
        raw = struct.pack(f"<{count}{'H' if kind == 3 else 'I'}", *(value if isinstance(value, list) else [value]))
        if len(raw) > 4:
            place = at + 2 + 8 * 12 + 4 + len(extra)
            extra += raw
            raw = struct.pack("<I", place)
        table.append(struct.pack("<HHI", t, kind, count) + raw.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<I", at) + b"".join(strips) + struct.pack("<H", 8) + b"".join(table) + b"\0" * 4 + extra


@pytest.mark.parametrize("deflate", [False, True])
def test_tiff_chunks_outside_a_window_are_not_read(spark, tmp_path, deflate):
    sources.register(spark)
    v = np.arange(200, dtype="<i2").reshape(20, 10) - 50
    (tmp_path / "a.tif").write_bytes(tif(v, 4, deflate))
    whole = spark.read.format("tiff").option("path", str(tmp_path / "a.tif")).load().orderBy("row0").collect()
    assert np.array_equal(np.concatenate([r.samples for r in whole]).reshape(20, 10), v)
    part = spark.read.format("tiff").options(path=str(tmp_path / "a.tif"), row0=5, row1=9, col0=0, col1=3).load()
    assert sorted(r.row0 for r in part.collect()) == [4, 8]


GOOD = """[source]
name = "a"
kind = "osm-pbf"
url = "https://example.org/a"
sha256 = "%s"
source_date = "2026-01-01"
licence = "x"
attribution = "y"
bounds = [-1, -2, 3, 4]
adapter_version = "v1"
""" % ("ab" * 32)


def test_descriptors_and_plans(spark):
    one = descriptors.descriptor(GOOD)
    assert descriptors.descriptors(spark, [GOOD]).first().bounds.east == 3.0
    for a, b in (("https", "http"), ("ab", "AB"), ("[-1, -2, 3, 4]", "[3, -2, -1, 4]"), ('licence = "x"\n', ""), ("osm-pbf", "csv")):
        with pytest.raises(ValueError):
            descriptors.descriptor(GOOD.replace(a, b))
    text = 'terrain_metres = 30.0\n[[layer]]\ndescriptor = "a"\ninput = "i"\nprecedence = 3\nlevels = [1, 7]\n[[terrain]]\ndescriptor = "a"\ninput = "t"\nstride = 4\n'
    layers, terrains, m = descriptors.plan(spark, text, {"a": one})
    assert layers.first().west == -1.0 and terrains.first().stride == 4 and m == 30.0
    with pytest.raises(ValueError):
        descriptors.plan(spark, text.replace("stride = 4\n", ""), {"a": one})
    known = spark.createDataFrame([("a", "0" * 64)], "name string, sha256 string")
    with pytest.raises(Exception, match="checksum mismatch"):
        descriptors.verified(spark.createDataFrame([("a", b"x")], "name string, content binary"), known).collect()


def test_streams(spark, tmp_path):
    from tilewright.streaming import cameras

    rows = [("s", "2026-01-01 00:00:00", 0.0, 0.0, 2.0), ("s", "2026-01-01 00:00:05", 90.0, 0.0, 2.0), ("t", "2026-01-01 00:00:01", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "session string, at string, lon double, lat double, zoom double").withColumn("at", F.col("at").cast("timestamp")).withColumns({"width": F.lit(200), "height": F.lit(200)})
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = cameras.demand(stream, [0, 2, 4]).writeStream.format("memory").queryName("plans").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.table("plans").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    first = {(r.z, r.x, r.y) for r in got if r.session == "s" and r.kind == "missing" and r.at.second == 0}
    later = {(r.z, r.x, r.y) for r in got if r.session == "s" and r.kind == "missing" and r.at.second == 5}
    assert first and not first & later
    assert {(r.z, r.x, r.y) for r in got if r.session == "t" and r.kind == "missing"} == {(0, 0, 0)}
    assert cameras.latest_cameras(df).where("session = 's'").first().lon == 90.0
    batch = cameras.quiet(df.select(F.col("session").alias("study"), "at"), "2 seconds").where("study = 's'").count()
    assert batch == 2


def test_tile_features_in_sql(spark):
    from tilewright.functions import sql

    sql.register(spark)
    spark.createDataFrame([(mt2_bytes(),)], "content binary").createOrReplaceTempView("held")
    got = spark.sql("SELECT f.* FROM held, LATERAL tile_features(content) AS f").collect()
    assert [(r["class"], r.id, r.vertices, r.holes) for r in got] == [(3, 2**40, 4, 1)]


def mt2_bytes():
    return tilefile.encode(1, 0, 0, [feature()])


def test_tiles_stream_through_small_batches(spark):
    from tilewright.sources import tilefile

    hole = [[(3, 3), (4, 3), (4, 4), (3, 3)]]
    rows = [(i % 3, "Water" if i % 2 else "Label", i, i % 4, 0, f"n{i}", [(1, 2), (9, 2), (9, 9), (1, 2)], hole if i % 4 == 1 else []) for i in range(50)]
    shape = "z int, x int, y int, class string, id long, flags int, rank int, name string, building struct<base_dm:int,top_dm:int,roof:string,material:string>, vertices array<struct<x:int,y:int>>, holes array<array<struct<x:int,y:int>>>"
    p = spark.createDataFrame([(2, x, 1, cls, i, flags, rank, name, None, v, h) for x, cls, i, flags, rank, name, v, h in rows], shape).repartition(5)
    heights = spark.createDataFrame([(2, 0, 1, bytearray(b"packed")), (2, 3, 3, bytearray(b"alone"))], "z int, x int, y int, packed binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        made = tilefile.built(p, heights)
        assert "collect_list" not in made._jdf.queryExecution().executedPlan().toString()
        out = {(t.z, t.x, t.y): t for t in made.collect()}
        back = sorted((f.x, f["class"], f.id, f.name, [tuple(v) for v in f.vertices], [[tuple(v) for v in h] for h in f.holes]) for f in tilefile.decoded(made).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: t.features for k, t in out.items()} == {(2, 0, 1): 17, (2, 1, 1): 17, (2, 2, 1): 16}
    assert [dict(tilefile.sections(bytes(out[2, x, 1].content))[2]).get(tilefile.HEIGHTS_PACKED) for x in range(3)] == [b"packed", None, None]
    code = {r["class"]: r.c for r in p.select("class", tilefile.style.class_code(F.col("class")).alias("c")).distinct().collect()}
    assert back == sorted((x, code[cls], i, name, v, h) for x, cls, i, _, _, name, v, h in rows)
    for t in out.values():
        of = sorted((code[r[1]], r[2], r) for r in rows if r[0] == t.x)
        plain = [{"class": c, "id": i, "flags": r[3], "rank": r[4], "name": r[5], "building": None, "vertices": r[6], "holes": r[7]} for c, i, r in of]
        assert bytes(t.content) == tilefile.encode(2, t.x, 1, plain, {tilefile.HEIGHTS_PACKED: b"packed"} if t.x == 0 else None)


def test_round_trip_compares_all_of_both_sides(spark, tmp_path, monkeypatch):
    from tilewright.plans import registry

    keys = spark.range(200, 232).withColumnRenamed("id", "o_orderkey")
    keys.write.parquet(str(tmp_path / "orders.parquet"))
    made = tilefile.built

    def rows(change):
        monkeypatch.setattr(tilefile, "built", lambda f: change(f))
        out = registry.QUERIES["tile_roundtrip"](spark, str(tmp_path)).collect()
        return len(out), sum(r.same for r in out), sum(r.features == r.decoded for r in out)

    n, same, counted = rows(made)
    assert n == same == counted > 32
    # As many features and vertices, but another rank, or a vertex moved, or the hole of another ring.
    assert rows(lambda f: made(f.withColumn("rank", F.col("rank") + 1))) == (n, 0, n)
    moved = F.transform("vertices", lambda p: F.struct((F.lit(65535) - p["x"]).alias("x"), p["y"].alias("y")))
    assert rows(lambda f: made(f.withColumn("vertices", moved))) == (n, 0, n)
    assert rows(lambda f: made(f.withColumn("holes", F.slice("holes", 2, 9))))[1] < n
    # Features in another order, and tiles that are lost.
    first, then, counted = rows(lambda f: made(f.withColumn("ordinal", -F.col("ordinal")).withColumn("id", F.lit(7))))
    assert (first, counted) == (n, n) and then < n
    assert rows(lambda f: made(f.where("class = 'Label'")))[0] == n


def test_round_trip_digests_follow_the_order_of_a_tile(spark):
    shape = "z int, x int, y int, class string, id long, flags int, rank int, name string, building struct<base_dm:int,top_dm:int,roof:string,material:string>, vertices array<struct<x:int,y:int>>, holes array<array<struct<x:int,y:int>>>, ordinal int"
    high = {"base_dm": 1, "top_dm": 9, "roof": tilefile.style.ROOFS[1], "material": tilefile.style.MATERIALS[1]}
    p = spark.createDataFrame([(2, 1, 1, "Building", 5, 0, 0, None, high, [(1, 2), (9, 2), (9, 9), (1, 2)], None, k) for k in (0, 1)] + [(2, 1, 1, "Label", 5, 0, 0, "é|", None, [(k, 2)], [], k) for k in (0, 1)], shape)
    (r,) = tilefile.compared(p, tilefile.built(p)).collect()
    assert r.same and (r.features, r.decoded, r.parts, r.vertices, r.vertices_decoded) == (4, 4, 4, 10, 10) and r.digest == r.digest_decoded
    (r,) = tilefile.compared(p, tilefile.built(p.withColumn("ordinal", -F.col("ordinal")))).collect()
    assert not r.same and r.vertices == r.vertices_decoded
