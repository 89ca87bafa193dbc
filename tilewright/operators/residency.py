"""Which tiles a camera needs: levels, spans, and the residency plan as rows.

Cameras are (session, lon, lat, zoom, width, height), resident tiles (session, z, x, y).  Bearing and tilt do not count.  The
plan is one relation (session, kind, z, x, y) with the kinds draw, missing, fallback, prefetch and evict; spans are generated
from arithmetic, so the only shuffles are the joins on (session, z, x, y).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid

# Fixed values.
KEEP_MARGIN, PREFETCH_ZOOM, MAX_TILT, MAX_ZOOM = 1, 4.0, 60.0, 22.0
TILE = ["session", "z", "x", "y"]


def patched(current: dict[str, Column], patch: dict[str, Column]) -> dict[str, Column]:
    """Camera fields after a patch; null fields stay, and a patch with a field that is not finite changes nothing."""
    bad = F.lit(False)
    for c in patch.values():
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    wrap = lambda v, n: v - n * F.floor(v / n)
    clamp = lambda v, lo, hi: F.least(F.greatest(v, F.lit(lo)), F.lit(hi))
    new = {
        "lon": wrap(patch["lon"] + 180.0, 360.0) - 180.0,
        "lat": clamp(patch["lat"], -grid.MAX_LATITUDE, grid.MAX_LATITUDE),
        "zoom": clamp(patch["zoom"], 0.0, MAX_ZOOM),
        "bearing": wrap(patch["bearing"], 360.0),
        "tilt": clamp(patch["tilt"], 0.0, MAX_TILT),
    }
    return {k: F.when(bad, current[k]).otherwise(F.coalesce(new[k], current[k])) for k in new}


def target_level(zoom: Column, levels: Column) -> Column:
    """The greatest level of a sorted array not above the zoom, else the first."""
    under = F.filter(levels, lambda z: z <= zoom)
    return F.coalesce(F.array_max(under), F.try_element_at(levels, F.lit(1)), F.lit(0))


def normalised_levels(levels: Column) -> Column:
    return F.array_sort(F.array_distinct(levels))


def spanned(cameras: DataFrame, levels: list[int]) -> DataFrame:
    """cameras with `spans`: an array of (role, z, x0, y0, x1, y1) for the target level, the coarser ones and the next."""
    known = F.array(*[F.lit(z) for z in sorted(set(levels))])
    target = target_level(F.col("zoom"), known)
    after = F.array_min(F.filter(known, lambda z: z > target))

    def span(z: Column) -> Column:
        s = grid.tile_span(F.col("lon"), F.col("lat"), F.col("zoom"), z, F.col("width"), F.col("height"))
        role = F.when(z == target, "target").when(z < target, "coarser").when(z == after, "next")
        return F.struct(role.alias("role"), z.alias("z"), *[s[k].alias(k) for k in ("x0", "y0", "x1", "y1")])

    return cameras.withColumn("spans", F.filter(F.transform(known, span), lambda s: s["role"].isNotNull()))


def tiles_in(span: DataFrame) -> DataFrame:
    """The tiles of each span (z, x0, y0, x1, y1), inside the world."""
    last = grid.side(F.col("z")) - 1
    at = span.withColumns({"x0": F.greatest("x0", F.lit(0)), "y0": F.greatest("y0", F.lit(0)), "x1": F.least("x1", last), "y1": F.least("y1", last)}).where("x0 <= x1 and y0 <= y1")
    return at.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "y0", "x1", "y1")


def plan(cameras: DataFrame, resident: DataFrame, levels: list[int]) -> DataFrame:
    """One camera a session.  Wanted tiles meet the resident ones once, and a row then says every kind that it stands for."""
    cams = spanned(cameras.withColumn("zoom", F.col("zoom").cast("double")), levels).select("session", "zoom", "spans")
    held = resident.select("session", F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    wanted = tiles_in(cams.select("session", "zoom", F.inline("spans")))
    met = wanted.join(held.withColumn("held", F.lit(True)), TILE, "left").withColumn("held", F.coalesce("held", F.lit(False)))
    own = Window.partitionBy("session")
    flag = lambda test, kind: F.when(F.expr(test), F.lit(kind))
    # The deepest coarser level with a resident tile stands in where the target has a hole.
    seen = met.withColumns({"deepest": F.max(F.when(F.expr("role = 'coarser' and held"), F.col("z"))).over(own), "hole": F.max(F.expr("role = 'target' and not held")).over(own)})
    kinds = F.array_compact(
        F.array(
            flag("role = 'target' or (role = 'coarser' and held and hole and z = deepest)", "draw"),
            flag("role = 'target' and not held", "missing"),
            flag("role = 'coarser' and not held", "fallback"),
            flag(f"role = 'next' and not held and zoom + {PREFETCH_ZOOM} >= z", "prefetch"),
        )
    )
    said = seen.select("session", F.explode(kinds).alias("kind"), "z", "x", "y")
    m = KEEP_MARGIN
    near = lambda s: (s["z"] == F.col("z")) & F.col("x").between(s["x0"] - m, s["x1"] + m) & F.col("y").between(s["y0"] - m, s["y1"] + m)
    gone = held.join(cams.select("session", "spans"), "session").where(~F.exists("spans", near)).select("session", F.lit("evict").alias("kind"), "z", "x", "y")
    return said.unionByName(gone)


def ancestors(tiles: DataFrame, depth: int = 4) -> DataFrame:
    """Each tile with itself and its ancestors up to `depth` levels above: columns up, az, ax, ay."""
    k = F.explode(F.sequence(F.lit(0), F.least(F.lit(depth), F.col("z"))))
    at = tiles.withColumn("up", k)
    shift = lambda c: F.call_function("shiftright", F.col(c), F.col("up"))
    return at.withColumns({"az": F.col("z") - F.col("up"), "ax": shift("x"), "ay": shift("y")})


def nearest_ancestor(tiles: DataFrame, held: DataFrame, depth: int = 4) -> DataFrame:
    """tiles with the nearest held ancestor (sz, sx, sy), null if none, and the window of its raster that the tile covers."""
    keys = held.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay")).distinct()
    found = ancestors(tiles.select("z", "x", "y").distinct(), depth).join(keys, ["az", "ax", "ay"])
    best = found.groupBy("z", "x", "y").agg(F.max(F.struct("az", "ax", "ay")).alias("s"))
    out = tiles.join(best, ["z", "x", "y"], "left").select(*tiles.columns, F.col("s.az").alias("sz"), F.col("s.ax").alias("sx"), F.col("s.ay").alias("sy"))
    share = 1.0 / F.pow(F.lit(2.0), (F.col("z") - F.col("sz")).cast("double"))
    off = lambda t, s: (F.col(t) - F.call_function("shiftleft", F.col(s).cast("long"), (F.col("z") - F.col("sz")).cast("int"))) * F.col("scale")
    return out.withColumn("scale", share).withColumns({"offset_x": off("x", "sx"), "offset_y": off("y", "sy")})


def level_box(boxes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, level) with the box of the nearest level at or above it in boxes (z, west, north, east, south)."""
    met = asked.join(boxes, F.col("z") <= F.col("level"))  # boxes has a row a level, 23 at most
    best = met.groupBy("key", "level").agg(F.max_by(F.struct("z", "west", "north", "east", "south"), "z").alias("b"))
    return asked.join(best, ["key", "level"], "left").select("key", "level", "b.*")


def drawn_buckets(drawn: DataFrame, buckets: DataFrame) -> DataFrame:
    """The buckets (z, x, y and more) of the tiles that are drawn (session, z, x, y); a tile without buckets gives no row."""
    return drawn.select("session", "z", "x", "y").distinct().join(buckets, ["z", "x", "y"])
