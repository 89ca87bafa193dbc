"""Cutting and meshing of many features at once: every part, triangle and ribbon equals that of the plain kernels."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.operators import mesh, parts, scenes
from tilewright.plans import vectors

KINDS = ("Water", "Park", "Building", "RoadPrimary", "Boundary", "Poi", "Land")
POINTS = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))


def feature(rng):
    kind, z = rng.choice(KINDS), rng.choice((0, 5, 7, 8, 12, 16))
    r = rng.choice((0.01, 0.3, 40.0)) / max(1, 2.0 ** (z - 6))
    x, y = rng.choice((rng.uniform(-180, 180), 0.0, 179.99, -180.0, 180.0)), rng.choice((rng.uniform(-85, 85), 0.0, 89.0))
    near = lambda: (round(x + rng.uniform(-r, r), 3), round(y + rng.uniform(-r, r), 9))
    v = [near() for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 20)))]
    if rng.random() < 0.3:
        v = [(x, y), (x + r, y), (x + r, y + r), (x, y + r)]
    if v and rng.random() < 0.5:
        v.append(v[0])
    holes = [[near() for _ in range(rng.choice((0, 1, 4)))] for _ in range(rng.choice((0, 0, 1, 2)))]
    return kind, z, v, [*holes, [(x + a * r, y + b * r) for a, b in ((0.3, 0.3), (0.6, 0.3), (0.6, 0.6), (0.3, 0.6))]]


def rows(r):
    at, xy = r.at.tolist(), list(zip(map(int, r.x), map(int, r.y), strict=True))
    return [xy[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]


def cut(found):
    """The parts of features by feature, as tile_parts gives them, and how many features were left to it."""
    point = lambda v: [{"lon": a, "lat": b} for a, b in v]
    columns = [pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), pa.array([point(f[2]) for f in found], POINTS), pa.array([[point(h) for h in f[3]] for f in found], pa.list_(POINTS))]
    batch = pa.RecordBatch.from_arrays(columns, names=["class", "z", "vertices", "holes"])
    holes_of = np.repeat(np.arange(len(found)), [len(f[3]) for f in found])
    out, left = [[] for _ in found], 0
    for own, made in parts.cut_groups([f[0] for f in found], [f[1] for f in found], parts.flat_points(batch.column("vertices")), parts.flat_points(batch.column("holes").flatten()), holes_of):
        if made is None:
            left += len(own)
            made = parts.cut_singly(batch.take(pa.array(own)))
        holes = [[] for _ in made.of]
        for k, h in zip(made.hole_of.tolist(), rows(made.holes), strict=True):
            holes[k].append(h)
        for i, x, y, v, h in zip(own[made.of].tolist(), made.x.tolist(), made.y.tolist(), rows(made.own), holes, strict=True):
            out[i].append((x, y, v, h))
    return out, left


def test_features_are_cut_together_as_singly():
    rng = random.Random(5)
    found = [feature(rng) for _ in range(1500)]
    out, left = cut(found)
    assert out == [list(parts.tile_parts(k, v, h, z)) for k, z, v, h in found]
    assert sum(map(len, out)) > 5000 and 0 < left < len(found) / 3


def test_large_features_are_left_to_the_plain_kernel(monkeypatch):
    rng = random.Random(6)
    found = [feature(rng) for _ in range(200)]
    whole, left = cut(found)
    monkeypatch.setattr(parts, "BLOCK", 40)
    assert cut(found)[0] == whole and cut(found)[1] > left


def ring(rng, x, y, r):
    n = rng.choice((0, 2, 3, 4, 5, 7, 12, 30))
    far = {"round": lambda i: r, "star": lambda i: r * (1 if i % 2 else 0.4), "wild": lambda i: rng.uniform(0, r)}[rng.choice(("round", "star", "wild"))]
    v = [(int(x + d * math.cos(i * 2 * math.pi / n)), int(y + d * math.sin(i * 2 * math.pi / n))) for i in range(n) for d in (far(i),)]
    v = v[::-1] if rng.random() < 0.4 else v
    return [*v, *v[:1]] if rng.random() < 0.6 else v


def test_rings_are_triangulated_together_as_singly():
    rng = random.Random(7)
    found = [(ring(rng, 30000, 30000, rng.choice((3, 20000))), [ring(rng, 30000 + rng.randint(-8000, 8000), 30000, rng.choice((2, 3000))) for _ in range(rng.choice((0, 0, 1, 2)))]) for _ in range(1500)]
    own, t, of = mesh.fills(parts._ragged([o for o, _ in found]), parts._ragged([h for _, hs in found for h in hs]), np.repeat(np.arange(len(found)), [len(hs) for _, hs in found]))
    turned = lambda q: min(q[i:] + q[:i] for i in range(3))
    by = [[] for _ in found]
    for i, q in zip(of.tolist(), (t - own.at[of][:, None]).tolist(), strict=True):
        by[i].append(turned(tuple(q)))
    for (outer, holes), v, got in zip(found, rows(own), by, strict=True):
        want = mesh.triangulate(outer, holes)
        assert (v, got) == (want[0], [turned(q) for q in want[1]])
    square = [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]
    v, t, _ = mesh.fills(parts._ragged([square]), parts._ragged([[(20, 20), (40, 20), (40, 40), (20, 40)]]), np.array([0]))
    assert mesh.triangles_area(rows(v)[0], t.tolist()) == 100 * 100 - 20 * 20


def test_lines_become_ribbons_together_as_singly():
    rng = random.Random(8)
    found = [[(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.choice((0, 1, 2, 3, 9)))] for _ in range(800)]
    v, n, miters, bevels = mesh.ribbons(parts._ragged(found))
    at = np.concatenate([[0], np.cumsum(n)])
    for i, line in enumerate(found):
        want = mesh.ribbon(line)
        assert (n[i], max(n[i] - 2, 0), miters[i], bevels[i]) == (len(want[0]), len(want[1]), *want[2:])
        assert v[at[i] : at[i + 1]].ravel().tolist() == pytest.approx([c for q in want[0] for c in q], abs=1e-6)


def test_buckets_hold_no_tile_in_one_row(spark):
    """A tile with many features is summed, not collected; ranges follow each other in their bucket."""
    b = scenes.building_grid(spark)
    square = F.expr("transform(array(0, 9, 9, 0, 0), (v, i) -> struct(cast(v as int) as x, cast(if(i in (2, 3), 9, 0) as int) as y))")
    many = b.limit(1).crossJoin(spark.range(3000).select(F.col("id").alias("n")))
    no_building = F.lit(None).cast(b.schema["building"].dataType)
    fills = many.select(F.col("n").alias("id"), F.when(F.col("n") % 3 == 0, "Park").otherwise("Water").alias("class"), "flags", "rank", "name", no_building.alias("building"), "z", "x", "y", square.alias("vertices"), "holes")
    lines = many.select(F.col("n").alias("id"), F.lit("RoadPrimary").alias("class"), F.when(F.col("n") < 10, 2).when(F.col("n") < 30, 4).otherwise(0).alias("flags"), "rank", "name", no_building.alias("building"), "z", "x", "y", F.slice(square, 1, 3).alias("vertices"), "holes")
    made = mesh.buckets(b.unionByName(fills).unionByName(lines))
    assert "collect_list" not in made._jdf.queryExecution().toString()
    got = {(r.kind, r["class"], r.material): (r["first"], r.triangles, r.area, r.miters, r.bevels) for r in made.where("kind <> 'building'").collect()}
    assert got == {
        ("fill", "Water", None): (0, 4000, 2000 * 81.0, 0, 0),
        ("fill", "Park", None): (4000, 2000, 1000 * 81.0, 0, 0),
        ("line", "RoadPrimary", "tunnel"): (0, 80, 0.0, 20, 0),
        ("line", "RoadPrimary", "ground"): (80, 2970 * 4, 0.0, 2970, 0),
        ("line", "RoadPrimary", "bridge"): (80 + 2970 * 4, 40, 0.0, 10, 0),
    }
    walls = [(r.material, r["first"], r.triangles) for r in made.where("kind = 'building'").orderBy("first").collect()]
    assert [w[1] for w in walls] == [sum(w[2] for w in walls[:i]) for i in range(7)]


def test_features_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    f = vectors._features(spark, str(tmp_path))
    assert f.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert f.count() == 40
