"""Tile packages: digests, envelopes, manifests, carving and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid

# Fixed values.
LISTED_TILES = 50_000


def envelopes(tiles: DataFrame) -> DataFrame:
    """west, north, east, south of each level's tiles (z, x, y)."""
    box = tiles.groupBy("z").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    lon = lambda x, c: grid.lon_at(F.col("z"), F.col(x).cast("long"), c)
    lat = lambda y, c: grid.lat_at(F.col("z"), F.col(y).cast("long"), c)
    return box.select("z", lon("lo_x", 0).alias("west"), lat("lo_y", 0).alias("north"), lon("hi_x", 65535).alias("east"), lat("hi_y", 65535).alias("south"))


def view(tiles: DataFrame) -> DataFrame:
    """One row lon, lat, zoom: the middle tile of the coarsest level."""
    first = tiles.groupBy("z").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).orderBy("z").limit(1)
    mid = lambda a, b: (F.col(a) + F.floor((F.col(b) - F.col(a)) / 2)).cast("long")
    return first.select(grid.lon_at(F.col("z"), mid("x0", "x1"), 32767).alias("lon"), grid.lat_at(F.col("z"), mid("y0", "y1"), 32767).alias("lat"), F.col("z").alias("zoom"))


def tile_digests(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, digest) of files with a tile path; others are no tiles."""
    return files.where(F.col("path").rlike(grid.PATH)).select("path", F.sha2(F.col(content), 256).alias("digest"))


def package_digest(digests: DataFrame) -> DataFrame:
    """One row: SHA-256 over path, NUL, digest and newline of every tile in byte order of the path.

    The concatenation is the definition, so its last step gathers all lines; packages of more than LISTED_TILES tiles should be
    verified by integrity() instead."""
    line = F.concat("path", F.lit("\0"), "digest", F.lit("\n"))
    lines = F.sort_array(F.collect_list(F.struct("path", line.alias("line"))))
    return digests.agg(F.sha2(F.array_join(F.transform(lines, lambda s: s["line"]), ""), 256).alias("package_sha256"), F.count("*").alias("tile_count"))


def integrity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path and state (same, changed, missing, extra) of every tile on either side."""
    both = expected.select("path", F.col("digest").alias("want")).join(actual.select("path", F.col("digest").alias("got")), "path", "full")
    state = F.when(F.col("want").isNull(), "extra").when(F.col("got").isNull(), "missing").when(F.col("want") == F.col("got"), "same").otherwise("changed")
    return both.select("path", state.alias("state"))


def carve(tiles: DataFrame, lon: float, lat: float, rules: list[tuple[int, int, int]], world: int | None = None) -> DataFrame:
    """Tiles up to the world level, or within a rule's radius (min level, max level, radius) of the subject's tile."""
    at = grid.locate(F.lit(float(lon)), F.lit(float(lat)), F.col("z"))
    keep = F.lit(False) if world is None else F.col("z") <= world
    for low, high, radius in rules:
        if low > high:
            raise ValueError("a rule's minimum level exceeds its maximum")
        keep = keep | (F.col("z").between(low, high) & (F.abs(F.col("x") - at["x"]) <= radius) & (F.abs(F.col("y") - at["y"]) <= radius))
    return tiles.where(keep)


def manifest(tiles: DataFrame, sources: list[dict], version: int = 6) -> DataFrame:
    """One row with the manifest as JSON; tiles: z, x, y, digest, features, has_heights.

    Paths and digests are listed only for packages of at most LISTED_TILES tiles, and are not even gathered beyond it."""
    path = grid.tile_path(F.col("z"), F.col("x"), F.col("y"))
    at = tiles.withColumn("path", path)
    levels = F.array_sort(F.collect_set("z"))
    head = at.agg(levels.alias("levels"), F.sum("features").alias("feature_count"), F.count("*").alias("tile_count"), F.count_if("has_heights").alias("height_tile_count")).first()
    digest = package_digest(at).first()["package_sha256"]
    boxes = {str(r["z"]): {k: r[k] for k in ("west", "north", "east", "south")} for r in envelopes(at).collect()}  # 23 levels at most
    listed = head["tile_count"] <= LISTED_TILES
    rows = at.orderBy("z", "x", "y").select("path", "digest").collect() if listed else []
    seen = view(at).first()
    import json

    body = {
        "format": "MT2",
        "format_version": version,
        "levels": head["levels"],
        "feature_count": head["feature_count"],
        "tile_count": head["tile_count"],
        "tiles": [r["path"] for r in rows] if listed else None,
        "tile_digests": {r["path"]: r["digest"] for r in rows} if listed else None,
        "package_sha256": digest,
        "bounds": boxes,
        "height_tile_count": head["height_tile_count"],
        "view": seen.asDict() if seen else None,
        "sources": sources,
    }
    return tiles.sparkSession.createDataFrame([(json.dumps(body),)], "manifest string")


def carved_manifest(tiles: DataFrame, source: str, lon: float, lat: float) -> DataFrame:
    """The manifest of a carve: its own counts, levels, envelopes and digests, the source manifest's version and sources word for
    word, its package digest as carved_from, and a view at the carve's centre on its deepest level."""
    import json

    held = json.loads(source)
    own = json.loads(manifest(tiles, held.get("sources") or [], held.get("format_version") or 6).first()["manifest"])
    own |= {"view": {"lon": lon, "lat": lat, "zoom": max(own["levels"], default=0)}, "carved_from": held.get("package_sha256")}
    return tiles.sparkSession.createDataFrame([(json.dumps(own),)], "manifest string")


def covers(asked: DataFrame, boxes: DataFrame, listed: DataFrame | None = None, absent: DataFrame | None = None) -> DataFrame:
    """asked (z, x, y) with `covered`: the package may hold the tile.

    A package that lists its tiles (listed: path) holds just those; another one holds what lies within the envelope (boxes: z,
    west, north, east, south; 23 rows at most) of the tile's level or of the nearest level above it.  Paths that were answered
    with not found (absent: path) are never covered.  Repeated rows are judged alike; without boxes nothing is covered."""
    at = asked.withColumn("path", grid.tile_path(F.col("z"), F.col("x"), F.col("y")))
    if listed is not None:
        at = at.join(listed.select("path", F.lit(True).alias("held")).distinct(), "path", "left")
    else:
        rows = boxes.select("z", "west", "north", "east", "south").orderBy(F.col("z").desc()).collect()  # a row a level
        box = "struct<z:int,west:double,north:double,east:double,south:double>"
        levels = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in rows]).cast(f"array<{box}>")
        best = F.try_element_at(F.filter(levels, lambda b: b["z"] <= F.col("z")), F.lit(1))
        lo, hi = (grid.locate(best[lon], best[lat], F.col("z")) for lon, lat in (("west", "north"), ("east", "south")))
        at = at.withColumn("held", F.col("x").between(lo["x"], hi["x"]) & F.col("y").between(lo["y"], hi["y"]))
    covered = F.coalesce("held", F.lit(False))
    if absent is not None:
        at = at.join(absent.select("path", F.lit(True).alias("gone")).distinct(), "path", "left")
        covered = covered & F.col("gone").isNull()
    return at.select(*asked.columns, covered.alias("covered"))


MANIFEST = "format string, format_version int, levels array<int>, feature_count long, tile_count long, tiles array<string>, tile_digests map<string,string>, bounds map<string,struct<west:double,north:double,east:double,south:double>>, package_sha256 string, view struct<lon:double,lat:double,zoom:int>, height_tile_count long, carved_from string, sources array<map<string,string>>"


def parsed_manifest(text: Column) -> Column:
    return F.from_json(text, MANIFEST)


def manifest_valid(m: Column) -> Column:
    """Known format and version, and tiles that are either listed with digests or bounded per level."""
    listed = m["tiles"].isNotNull() & m["tile_digests"].isNotNull()
    return F.coalesce((m["format"] == "MT2") & m["format_version"].between(2, 6) & (listed | (m["levels"].isNotNull() & m["bounds"].isNotNull())), F.lit(False))


def totals(levels: DataFrame) -> DataFrame:
    """Build totals over per-level counts."""
    return levels.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("features", "height_tiles", "covered", "matched")])


def retryable(status: Column) -> Column:
    """Responses worth one more try: none at all, 429, or a server error."""
    return status.isNull() | (status == 429) | (status >= 500)
