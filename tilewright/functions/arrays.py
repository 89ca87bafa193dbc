"""Vertex arrays (array<struct<x,y>>) as higher-order expressions; every input array is bound once per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pairs(v: Column, f) -> Column:
    """f(a, b) over neighbours; fewer than two elements give none."""
    n = F.greatest(F.size(v) - 1, F.lit(0))
    return F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(2), n), f)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def deltas(v: Column) -> Column:
    """The first vertex, then differences to the one before."""
    diff = pairs(v, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    return F.concat(F.slice(v, 1, 1), diff)


def undeltas(v: Column) -> Column:
    """Vertices from deltas, by a running sum."""

    def step(held: Column, d: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        return F.concat(held, F.array(F.struct((F.coalesce(last["x"], F.lit(0)) + d["x"]).cast("int").alias("x"), (F.coalesce(last["y"], F.lit(0)) + d["y"]).cast("int").alias("y"))))

    return F.aggregate(v, F.array().cast("array<struct<x:int,y:int>>"), step)


def lengths(v: Column) -> Column:
    return pairs(v, lambda a, b: F.hypot((b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double")))


def arc_length(v: Column) -> Column:
    return total(lengths(v))


def deduplicated(v: Column) -> Column:
    """Without vertices equal to the one before."""
    return bound(v, lambda a: F.filter(a, lambda p, i: (i == 0) | (p != F.get(a, i - 1))))


def signed_area(ring: Column) -> Column:
    """Shoelace sum over the closed ring; the last vertex joins the first."""
    closed = bound(ring, lambda r: F.concat(r, F.slice(r, 1, 1)))
    return total(pairs(closed, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))) / 2.0


def contains(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd crossings of a closed ring (first vertex repeated at its end)."""
    crossed = pairs(ring, lambda a, b: ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0).cast("double")) + a["x"]))
    return F.size(F.filter(crossed, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def is_closed(v: Column) -> Column:
    return (F.size(v) > 3) & (F.try_element_at(v, F.lit(1)) == F.try_element_at(v, F.lit(-1)))


def midpoint(v: Column) -> Column:
    """The rounded point half-way along a line; the last vertex of a line without length.

    Halves are rounded away from zero, and what lies within a millionth of a half counts as one."""

    def walk(state: Column, s: Column) -> Column:
        hit = state["p"].isNull() & (s["d"] > 0) & (state["left"] <= s["d"])
        t = state["left"] / s["d"]
        at = lambda a, b: F.round(F.round(a + (b - a) * t, 6))
        point = F.struct(at(s["ax"], s["bx"]).alias("x"), at(s["ay"], s["by"]).alias("y"))
        return F.struct(F.when(hit, point).otherwise(state["p"]).alias("p"), F.when(state["p"].isNull() & ~hit, state["left"] - s["d"]).otherwise(state["left"]).alias("left"))

    d = lambda c: c.cast("double")
    parts = pairs(v, lambda a, b: F.struct(d(a["x"]).alias("ax"), d(a["y"]).alias("ay"), d(b["x"]).alias("bx"), d(b["y"]).alias("by"), F.hypot(d(b["x"] - a["x"]), d(b["y"] - a["y"])).alias("d")))
    start = F.struct(F.lit(None).cast("struct<x:double,y:double>").alias("p"), (arc_length(v) / 2.0).alias("left"))
    found = F.aggregate(parts, start, walk, lambda s: s["p"])
    end = F.try_element_at(v, F.lit(-1))
    return F.coalesce(found, F.struct(d(end["x"]).alias("x"), d(end["y"]).alias("y")))


def zigzag(n: Column) -> Column:
    """Small magnitudes of either sign to small non-negative numbers."""
    return F.when(n >= 0, n.cast("long") * 2).otherwise(n.cast("long") * -2 - 1)


def varint_size(n: Column) -> Column:
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)
