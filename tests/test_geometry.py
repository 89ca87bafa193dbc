from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import arrays, grid, style, tags
from tilewright.operators import assembly, conflate, parts, placement, raster, rollup
from tilewright.plans import tiles


def test_rings_stitch_reverse_rotate_and_drop_open_chains():
    assert assembly.stitched([[3, 4, 1], [3, 2], [2, 1]]) == [[1, 2, 3, 4, 1]]
    assert assembly.stitched([[1, 2], [2, 3]]) == []
    assert assembly.stitched([]) == []
    assert assembly.stitched([[5, 6, 7, 5], [1, 2, 3, 1]]) == [[5, 6, 7, 5], [1, 2, 3, 1]]


def test_relations_suppress_their_members_and_count_a_member_once(spark):
    water = {"natural": "water"}
    nodes = spark.createDataFrame([(i, float(i % 2), float(i // 2), {}) for i in range(4)] + [(10, 0.2, 0.2, {}), (11, 0.4, 0.2, {}), (12, 0.3, 0.4, {})], "id long, lon double, lat double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [0, 1, 3, 2, 0], water), (11, [10, 11, 12, 10], {}), (12, [0, 1], {"highway": "path"})], "id long, nodes array<long>, tags map<string,string>")
    rel = spark.createDataFrame([(20, water, [("way", 10, "outer"), ("way", 10, "outer"), ("way", 11, "inner"), ("way", 99, "outer")])], "id long, tags map<string,string>, members array<struct<kind:string,ref:long,role:string>>")
    kept = assembly.kept_relations(rel)
    held = assembly.kept_ways(ways, kept)
    assert {r.id for r in assembly.own_ways(held).collect()} == {12}
    out = assembly.polygons(kept, ways, nodes).collect()
    assert len(out) == 1 and len(out[0].outer) == 5 and len(out[0].holes) == 1
    assert assembly.located(ways, nodes).count() == 3
    broken = spark.createDataFrame([(1, [0, 77], {})], ways.schema)
    with pytest.raises(Exception, match="missing node 77"):
        assembly.located(broken, nodes).collect()
    assert assembly.located(broken, nodes, "drop").count() == 0


def test_seam_cuts_lines_and_rings():
    assert parts.seam_lines([(179.0, 0.0), (-179.0, 2.0)]) == [[(179.0, 0.0), (180.0, 1.0)], [(-180.0, 1.0), (-179.0, 2.0)]]
    assert parts.seam_lines([(1.0, 0.0), (2.0, 0.0)]) == [[(1.0, 0.0), (2.0, 0.0)]]
    ring = [(179.0, 0.0), (-179.0, 0.0), (-179.0, 2.0), (179.0, 2.0), (179.0, 0.0)]
    cut = parts.seam_rings(ring)
    assert len(cut) == 2
    assert all(-180.0 <= x <= 180.0 for r in cut for x, _ in r)
    assert sum(abs(parts.ring_area(r)) for r in cut) == pytest.approx(4.0)
    assert parts.seam_rings([]) == []


def test_clipping_keeps_area_and_length():
    rng = random.Random(3)
    for _ in range(20):
        c = (rng.uniform(1, 3), rng.uniform(1, 3))
        ring = [(c[0] + rng.uniform(0.3, 1.2) * math.cos(a), c[1] + rng.uniform(0.3, 1.2) * math.sin(a)) for a in sorted(rng.uniform(0, 2 * math.pi) for _ in range(9))]
        tiles_ = parts.covered(ring, 3)
        assert sum(parts.ring_area(r) for x, y in tiles_ if (r := parts.clip_ring(ring, x, y))) == pytest.approx(parts.ring_area(ring))
        length = lambda line: sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))
        assert sum(length(p) for x, y in tiles_ for p in parts.clip_line(ring, x, y)) == pytest.approx(length(ring))


def test_simplification_keeps_ends_and_far_points():
    line = [(0.0, 0.0), (0.1, 1e-9), (0.2, 0.5), (0.3, 0.0)]
    assert parts.simplify_line(line, "RoadPrimary", 14) == [line[0], line[2], line[3]] or len(parts.simplify_line(line, "RoadPrimary", 14)) == 4
    assert parts.simplify_line(line, "RoadPrimary", 16) == line
    assert parts.simplify_line(line, "Boundary", 2) == line


def test_snapping_drops_creases_and_keeps_simple_rings():
    s = parts.SNAP_STEP
    square = [(0.0, 0.0), (10 * s, 0.0), (10 * s, 10 * s), (0.0, 10 * s)]
    assert parts.snapped(square) == square
    spike = [(0.0, 0.0), (10 * s, 0.0), (20 * s, 0.0), (10 * s, 0.0), (10 * s, 10 * s)]
    assert len(set(parts.snapped(spike))) == len(parts.snapped(spike)) == 3
    assert parts.snapped([(0.0, 0.0), (s / 5, 0.0), (0.0, s / 5)]) == []
    out = parts.snapped([(0.0, 0.0), (0.0, s / 5), (3 * s, 0.0), (3 * s, 3 * s)])
    assert len(out) == 3


def test_parts_of_features(spark):
    v = "array<struct<lon:double,lat:double>>"
    f = spark.createDataFrame(
        [(1, {"place": "city", "name": "A"}, [(10.0, 10.0)], []), (2, {"highway": "primary"}, [(0.0, 0.0), (1.0, 1.0)], []), (3, {"shop": "x"}, [(0.0, 0.0)], []), (4, {"natural": "water"}, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)], [[(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8), (0.2, 0.2)]]), (5, {"place": "hamlet"}, [(0.0, 0.0)], [])],
        f"id long, tags map<string,string>, vertices {v}, holes array<{v}>",
    )
    rows = parts.parts(f, [4, 10]).collect()
    assert {(r.id, r.z) for r in rows} == {(1, 4), (1, 10), (2, 10), (4, 4), (4, 10)}
    assert all(r.vertices[0] == r.vertices[-1] for r in rows if r.id == 4)
    assert sum(len(r.holes) for r in rows if r.id == 4 and r.z == 10) > 0
    assert parts.parts(f.limit(0), [4]).count() == 0


def _fold(rows, claims, metres=25000.0):
    """Layers one after another, as a list."""
    fate, named, done = {}, [], []
    for c in sorted(claims, key=lambda c: (-c["precedence"], c["layer_id"])):
        mine = []
        for r in rows:
            if r["layer_id"] != c["layer_id"]:
                continue
            if not c["min_level"] <= r["level"] <= c["max_level"]:
                fate[r["part_id"]] = "inactive"
                continue
            inside = lambda d, r=r: d["precedence"] > c["precedence"] and d["min_level"] <= r["level"] <= d["max_level"] and d["west"] <= r["lon"] <= d["east"] and d["south"] <= r["lat"] <= d["north"]  # noqa: E731, B023
            if any(map(inside, done)):
                fate[r["part_id"]] = "covered"
                continue
            key = r["name"].strip().lower() if r["class"] in ("Label", "Poi") else ""
            gap = lambda n, r=r: math.hypot((r["lon"] - n[2]) * math.cos(math.radians((r["lat"] + n[3]) / 2)) * 111320.0, (r["lat"] - n[3]) * 111320.0)
            if key and any(n[0] == key and n[1] == r["level"] and gap(n) <= metres for n in named):
                fate[r["part_id"]] = "matched"
                continue
            fate[r["part_id"]] = "kept"
            if key:
                mine.append((key, r["level"], r["lon"], r["lat"]))
        named += mine
        done.append(c)
    return fate


def test_conflation_equals_a_sequential_fold(spark):
    d = "/root/testdata/sf0.001"
    p, c = tiles._parts(spark, d).withColumn("lon", F.col("lon") / 20).withColumn("lat", F.col("lat") / 20), tiles._claims(spark, d)
    want = _fold([r.asDict() for r in p.collect()], [r.asDict() for r in c.collect()])
    got = {r.part_id: r.fate for r in conflate.conflate(p, c, 200000.0).collect()}
    assert {k: v for k, v in _fold([r.asDict() for r in p.collect()], [r.asDict() for r in c.collect()], 200000.0).items()} == got
    assert {"kept", "covered", "inactive"} <= set(want.values())


def test_placement_invariants(spark):
    rows, seed = [], 7
    for i in range(300):
        seed = (seed * 1103515245 + 12345) % 2**31
        x, seed = seed % 900 - 50, (seed * 1103515245 + 12345) % 2**31
        rows.append((i % 3, 12, i % 290, i % 10, f"n{i % 40}", float(x), float(seed % 700 - 50), 40.0 + 12 * (i % 7), 14.0, i % 2 == 0))
    schema = "frame_id int, class int, fid long, rank int, text string, ax float, ay float, w float, h float, repeats_by_text boolean"
    df = spark.createDataFrame(rows, schema)
    out = placement.place(df, 800.0, 600.0, 0.3)
    got = out.collect()
    assert len(got) == 300
    boxes = [r for r in got if r.state == "placed"]
    for i, a in enumerate(boxes):
        for b in boxes[i + 1 :]:
            assert a.frame_id != b.frame_id or not (a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1)
    assert placement.rank_inversions(out).count() == 0
    assert all(r.occupancy <= 0.3 + 1e-6 for r in placement.occupancy(out, 800.0, 600.0).collect())
    again = {(r.frame_id, r.fid, r.state) for r in placement.place(spark.createDataFrame(rows[::-1], schema), 800.0, 600.0, 0.3).collect()}
    assert again == {(r.frame_id, r.fid, r.state) for r in got}
    few = {(r.frame_id, r.fid) for r in placement.place(df, 800.0, 600.0, 0.05).collect() if r.state == "placed"}
    assert few <= {(r.frame_id, r.fid) for r in boxes}
    assert placement.place(df.limit(0), 800.0, 600.0).count() == 0


def test_height_codec_round_trip_and_damage():
    import os

    raw = os.urandom(raster.RASTER_BYTES)
    assert raster.unpack(raster.pack(raw)) == raw
    flat = (11000).to_bytes(2, "little") * (raster.SIDE**2)
    assert raster.unpack(raster.pack(flat)) == flat and len(raster.pack(flat)) < 1000
    with pytest.raises(ValueError):
        raster.pack(raw[:-2])
    with pytest.raises(ValueError):
        raster.unpack(raster.pack(raw)[:-200])
    with pytest.raises(ValueError):
        raster.unpack(b"\xff" * 40)


def test_windows_and_strides():
    assert raster.window(-1, -1, 1, 1, (-10, -10, 10, 10), 20, 20) == (9, 9, 11, 11)
    for bad in ((20, 20, 30, 30), (1, 1, 1, 2)):
        with pytest.raises(ValueError):
            raster.window(*bad, (-10, -10, 10, 10), 20, 20)
    with pytest.raises(ValueError):
        raster.window(-10, -10, 10, 10, (-10, -10, 10, 10), 10000, 10000)


def test_terrain_cap_table(spark):
    rows = [(30.0, 12), (460.0, 8), (1.0, 17), (0.0, 12), (-5.0, 12), (float("nan"), 12), (None, 12), (1e9, 0)]
    got = spark.createDataFrame(rows, "m double, want int").select("want", grid.terrain_cap(F.col("m")).alias("got")).collect()
    assert all(r.got == r.want for r in got), got


def test_tags_cover_the_precedence_chains(spark):
    rows = [({"height": "12 m"}, 12.0), ({"height": "x", "building:levels": "2"}, 6.0), ({"height": "-3"}, 9.0), ({}, 9.0), (None, None)]
    got = spark.createDataFrame(rows, "t map<string,string>, want double").select("want", tags.height(F.col("t"))["metres"].alias("m"), tags.classify(F.col("t")).alias("c")).collect()
    assert [round(r.m, 3) for r in got[:4]] == [12.0, 6.0, 9.0, 9.0] and got[4].c is None
    assert spark.range(1).select(style.band_at(F.lit(-1.0)).alias("b")).first().b == "World"


def test_empty_and_short_arrays(spark):
    v = "array<struct<x:int,y:int>>"
    df = spark.createDataFrame([([],), ([(1, 2)],), ([(1, 2), (1, 2), (4, 6)],), (None,)], f"v {v}")
    got = df.select(arrays.arc_length(F.col("v")).alias("l"), F.size(arrays.deltas(F.col("v"))).alias("d"), F.size(arrays.deduplicated(F.col("v"))).alias("u")).collect()
    assert [r.l for r in got][:3] == [0.0, 0.0, 5.0] and [r.d for r in got][:3] == [0, 1, 3] and [r.u for r in got][:3] == [0, 1, 2]


def test_rollups_on_ties_and_nothing(spark):
    s = spark.createDataFrame([("a", "render", 1, 5.0), ("a", "render", 2, 5.0), ("a", "io", 3, 9.0)], "study string, phase string, seq long, ms double")
    assert [tuple(r) for r in rollup.worst(s, ("study",)).collect()] == [("a", "render", 1, 5.0)]
    assert rollup.phases(s.limit(0)).count() == 0
    assert rollup.retained(s, "study", 1).first().seq == 3


def test_box_and_repeat_pairs_are_made_from_classes_and_never_broadcast(spark):
    at = [(7 * i % 5 * 20.0, 11 * i % 3 * 15.0) for i in range(60)] + [(0.0, 0.0)] * 30
    rows = [(None if i == 7 else i if i < 85 else 84, "ab"[i % 2] if i % 9 else "", x, y, x, y, x + 25.0, y + 10.0) for i, (x, y) in enumerate(at)]
    b = spark.createDataFrame(rows, "id int, text string, ax double, ay double, x0 double, y0 double, x1 double, y1 double").repartition(3)
    pairs = [(p, q) for p in rows for q in rows if p[0] is not None and q[0] is not None and p[0] < q[0]]
    over = sorted((p[0], q[0]) for p, q in pairs if p[4] < q[6] and q[4] < p[6] and p[5] < q[7] and q[5] < p[7])
    near = sorted((p[0], q[0]) for p, q in pairs if p[1] and p[1] == q[1] and math.hypot(p[2] - q[2], p[3] - q[3]) <= 30)
    for made, want in ((placement.overlaps(b), over), (placement.near_repeats(b, radius=30.0), near)):
        assert sorted(map(tuple, made.collect())) == want
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "collect_list" in plan
