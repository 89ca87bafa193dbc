"""Layers that describe the same ground: coverage and identity.

Coverage: a part whose representative point lies inside the claim of a layer of strictly higher precedence, active at its
level, goes.  Identity: a place (Label or Poi) goes if a place of the same trimmed lower-case name within 25 km was kept from
any earlier layer, peers included; places of one layer never compete with each other.

Claims are as few as the plan has layers, so coverage is an equi-join on the level, broadcast if its size allows.  Identity goes
layer by layer: an equi-join on name, level and a cell of the match distance against what earlier layers kept, which is read
from the table that the layers' fates are appended to, so the plan of a layer does not contain those before it.

Defined cases: a null or blank name is no name and matches nothing; a part without a point (or a layer without a claim) is in
no claim and in no result; equal parts of one layer are all kept; no layers or no parts give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid, tags
from ..tables import dropped, new_path, written

# Fixed values.
MATCH_METRES = 25000.0
PLACES = ("Label", "Poi")
#: Claims beyond this many are not broadcast but joined by level.
BROADCAST_CLAIMS = 10_000


def claimed_levels(claims: DataFrame) -> DataFrame:
    return claims.select(F.explode(F.sequence("min_level", "max_level")).alias("level")).distinct()


def epochs(claims: DataFrame) -> DataFrame:
    """claims with `epoch`, 1 for the highest precedence; peers share one."""
    return claims.withColumn("epoch", F.dense_rank().over(Window.orderBy(F.col("precedence").desc())))


def covered(parts: DataFrame, claims: DataFrame) -> DataFrame:
    """parts with `covered`; parts: part_id, layer_id, level, lon, lat; claims: layer_id, precedence, box, levels."""
    own = claims.select("layer_id", F.col("precedence").alias("own"))
    at = claims.select(F.explode(F.sequence("min_level", "max_level")).alias("level"), F.col("precedence").alias("other"), "west", "south", "east", "north")
    if claims.count() <= BROADCAST_CLAIMS:  # a claim has as many rows here as it has levels
        own, at = F.broadcast(own), F.broadcast(at)
    on = F.expr("p.level = c.level and other > own and lon between west and east and lat between south and north")
    hit = parts.join(own, "layer_id").alias("p").join(at.alias("c"), on, "left_semi").select("part_id", F.lit(True).alias("covered"))
    return parts.join(hit.distinct(), "part_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def _cell(lon: Column, band: Column, metres: float) -> Column:
    """The cell of a longitude in a band of latitude; cells are `metres` wide or more all over the band."""
    tall = metres / grid.METRES_PER_DEGREE
    edge = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * tall, F.lit(89.0))
    return F.floor(lon * F.cos(F.radians(edge)) / tall)


def _cells(lon: Column, lat: Column, metres: float) -> Column:
    """(band, cell) of all cells that hold points within `metres` of a point: at most three bands of a few cells each."""
    tall = metres / grid.METRES_PER_DEGREE
    # The distance takes the cosine of the mean latitude, which is half a band from the point's at most.
    wide = tall / F.cos(F.radians(F.least(F.abs(lat) + tall, F.lit(89.0)))) * 1.001
    band = F.floor(lat / tall)
    near = F.transform(F.sequence(band - 1, band + 1), lambda b: F.transform(F.sequence(_cell(lon - wide, b, metres), _cell(lon + wide, b, metres)), lambda c: F.struct(b.alias("band"), c.alias("cell"))))
    return F.flatten(near)


def conflate(parts: DataFrame, claims: DataFrame, metres: float = MATCH_METRES) -> DataFrame:
    """parts with `fate`: kept, covered, matched or inactive.  parts also has class and name.  Runs one job a layer."""
    c = covered(parts, claims).join(F.broadcast(claims.select("layer_id", "precedence", "min_level", "max_level")), "layer_id")  # a row a layer
    named = F.when(F.col("class").isin(*PLACES), F.nullif(tags.place_name(F.col("name")), F.lit("")))
    fate = F.when(~F.expr("level between min_level and max_level"), "inactive").when(F.col("covered"), "covered")
    base = written(c.select(*parts.columns, named.alias("key"), fate.alias("fate")), "conflate")
    spark, path = parts.sparkSession, new_path(parts.sparkSession, "fates")
    base.limit(0).write.parquet(path)
    done = lambda: spark.read.schema(base.schema).parquet(path)
    band = F.floor(F.col("lat") / (metres / grid.METRES_PER_DEGREE))
    # Layers in order of precedence; their number is the plan's, not the data's.
    for layer in [r["layer_id"] for r in claims.orderBy(F.col("precedence").desc(), "layer_id").select("layer_id").collect()]:
        mine = base.where(F.col("layer_id") == layer)
        kept = done().where("fate = 'kept' and key is not null").select("key", "level", "lon", "lat", band.alias("band"), _cell(F.col("lon"), band, metres).alias("cell"))
        live = mine.where("fate is null and key is not null").withColumn("at", F.explode(_cells(F.col("lon"), F.col("lat"), metres)))
        near = grid.metres_between(F.col("k.lon"), F.col("k.lat"), F.col("m.lon"), F.col("m.lat")) <= metres
        gone = live.alias("m").join(kept.alias("k"), F.expr("m.key = k.key and m.level = k.level and m.at.band = k.band and m.at.cell = k.cell") & near, "left_semi")
        late = gone.select("part_id", F.lit("matched").alias("late")).distinct()
        judged = mine.join(late, "part_id", "left").withColumn("fate", F.coalesce("fate", "late", F.lit("kept")))
        judged.select(*base.columns).write.mode("append").option("compression", "zstd").parquet(path)
    dropped(base)
    return done().drop("key")


def report(fates: DataFrame) -> DataFrame:
    return fates.where("fate <> 'inactive'").agg(*[F.count_if(F.col("fate") == f).alias(f) for f in ("kept", "covered", "matched")])
