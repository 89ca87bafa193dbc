"""Ways and relations to geometry.

Tables: nodes (id, lon, lat, tags), ways (id, nodes array<long>, tags), relations (id, tags, members array<struct<kind, ref, role>>).
A relation is kept if it classifies and has an outer member; members of any kept relation are not emitted on their own, even if
their own tags classify.  Missing member ways are dropped; a missing node is an error that names the way or the relation.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags

VERTEX = "struct<lon:double,lat:double>"


def kept_relations(relations: DataFrame) -> DataFrame:
    part = lambda keep: F.transform(F.filter("members", lambda m: (m["kind"] == "way") & keep(m)), lambda m: m["ref"])
    r = relations.withColumns({"class": tags.classify(F.col("tags")), "outer": part(lambda m: m["role"].isin("outer", "")), "inner": part(lambda m: m["role"] == "inner")})
    return r.where(F.col("class").isNotNull() & (F.size("outer") > 0)).select("id", "tags", "class", "outer", "inner")


def member_ids(kept: DataFrame) -> DataFrame:
    return kept.select(F.explode(F.concat("outer", "inner")).alias("id")).distinct()


def kept_ways(ways: DataFrame, kept: DataFrame) -> DataFrame:
    """Ways that classify, or that a kept relation holds: columns class (null if only held) and member."""
    held = member_ids(kept).withColumn("member", F.lit(True))
    w = ways.withColumn("class", tags.classify(F.col("tags"))).join(held, "id", "left").withColumn("member", F.coalesce("member", F.lit(False)))
    return w.where("class is not null or member")


def own_ways(ways: DataFrame) -> DataFrame:
    """Of kept_ways() those that are features themselves."""
    return ways.where("not member")


def point_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("class", tags.classify(F.col("tags"))).where(F.col("class").isin("Poi", "Label"))


def referenced(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Coordinates of the nodes that ways name: a semi-join, so nothing is collected."""
    return nodes.select("id", "lon", "lat").join(ways.select(F.explode("nodes").alias("id")).distinct(), "id", "left_semi")


def located(ways: DataFrame, nodes: DataFrame, missing: str = "error") -> DataFrame:
    """ways with `vertices` in node order; missing='error' raises for a way that names an absent node, 'drop' leaves it out."""
    at = ways.select("id", F.posexplode("nodes").alias("pos", "node"))
    met = at.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node", "left")
    v = met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "lon", "lat"))).alias("v"), F.min(F.when(F.col("lon").isNull(), F.col("node"))).alias("absent"))
    if missing == "drop":
        v = v.where("absent is null")
    else:
        v = v.withColumn("v", F.when(F.col("absent").isNull(), F.col("v")).otherwise(F.raise_error(F.format_string("way %d names missing node %d", "id", "absent"))))
    return ways.join(v.select("id", F.transform("v", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("vertices")), "id")


def stitched(ways: list[list[int]]) -> list[list[int]]:
    """Closed rings chained from unordered ways by their end nodes; open chains are left out; a ring starts at its least node."""
    left = [list(w) for w in ways]
    rings = []
    closed = lambda r: len(r) > 3 and r[0] == r[-1]
    while (seed := next((i for i, w in enumerate(left) if len(w) > 1), None)) is not None:
        ring = left.pop(seed)
        while not closed(ring):
            tail = ring[-1]
            found = next((i for i, w in enumerate(left) if w and tail in (w[0], w[-1])), None)
            if found is None:
                break
            way = left.pop(found)
            ring += (way[::-1] if way[-1] == tail else way)[1:]
        if closed(ring):
            body = ring[:-1]
            first = body.index(min(body))
            rings.append([*body[first:], *body[:first], body[first]])
    return rings


def rings(kept: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, role, ring_no, nodes): the rings of each relation's outer and inner members; a member named twice counts once.

    A group is one relation's members of one role, which a relation's own size bounds."""
    member = lambda role: kept.select("id", F.lit(role).alias("role"), F.posexplode(F.array_distinct(role)).alias("pos", "way"))
    met = member("outer").unionByName(member("inner")).join(ways.select(F.col("id").alias("way"), "nodes"), "way")

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        found = stitched([list(n) for n in group.sort_values("pos")["nodes"]])
        return pd.DataFrame({"id": key[0], "role": key[1], "ring_no": range(len(found)), "nodes": found})

    return met.select("id", "role", "pos", "nodes").groupBy("id", "role").applyInPandas(run, "id long, role string, ring_no int, nodes array<long>")


def polygons(kept: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, ring_no, outer, holes): each outer ring with the holes whose first vertex lies inside it."""
    from ..functions import arrays

    r = rings(kept, ways)
    key = F.struct("id", "role", "ring_no")
    shaped = located(r.select(F.xxhash64("id", "role", "ring_no").alias("id"), key.alias("k"), "nodes"), nodes).select("k.*", "vertices")
    xy = F.transform("vertices", lambda v: F.struct(v["lon"].alias("x"), v["lat"].alias("y")))
    outer = shaped.where("role = 'outer'").select("id", "ring_no", xy.alias("ring"), F.col("vertices").alias("outer"))
    inner = shaped.where("role = 'inner'").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ring_no", "vertices"))).alias("inner"))
    both = outer.join(inner, "id", "left")
    holes = F.transform(F.filter(F.coalesce("inner", F.array().cast(f"array<struct<ring_no:int,vertices:array<{VERTEX}>>>")), lambda h: arrays.contains(F.col("ring"), h["vertices"][0]["lon"], h["vertices"][0]["lat"])), lambda h: h["vertices"])
    return both.select("id", "ring_no", "outer", holes.alias("holes"))
