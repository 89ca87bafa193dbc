"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

1. source_targets(): every source's words and its target, by water-filling under the repetition cap.
2. take(): whole epochs and a partial one per document; inside a source documents stand in hash order and the partial epoch
   ends exactly where the target is reached, so a source's taken words equal its target rounded to whole words.
3. schedule(): each source's weight over training time t in 0..1 is w(t) = 1 + tilt * (2t - 1).  Its integral
   W(t) = t + tilt * (t*t - t) is the share of the source's tokens due by t; inverting it at a copy's cumulative demand, that
   of the whole epochs before it and of the documents before it, gives the copy's position, and copies are range-sorted by it.

Running sums inside a source go over hash buckets first and then inside a bucket, so no task holds one source's documents.
Defined cases: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0 take 0; equal
hashes are ordered by key; an empty table gives an empty mix.  Repeated rows with one key share a place in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_of, words_of, written

WEIGHTS = (5, 2, 1)
CAP = 3
#: Tilt by rank of the source, repeating: -1 trains it early, 0 evenly, 1 late.
TILTS = (-0.5, 0.0, 0.5)


def _cycle(values, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((rank - 1) % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0, tilts=TILTS) -> DataFrame:
    """(source, source_size, rank, target, tilt) from (source, size).  The only single-task window runs over one row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("w", _cycle(weights, F.col("rank")).cast("double")).withColumn("limit", F.col("source_size") * F.lit(cap))
    # Water level: with sources ordered by limit per weight, the first k are full; the level is what is left over the open weight.
    order = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = weighed.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("w").over(after))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), F.col("rank"), F.col("level")))).over(everything)["level"]
    filled = level.withColumn("first", first)
    target = F.when(F.col("first").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("first") * F.col("w")))
    return filled.select("source", "source_size", "rank", target.alias("target"), _cycle(tilts, F.col("rank")).cast("double").alias("tilt"))


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = CAP, share: float = 1.0, tilts=TILTS, carry: bool = False) -> DataFrame:
    """(key, size, source_size, target, taken, position, positions), unsorted.

    positions holds the training position in 0..1 of each copy of the document, and position the first of them; both are null
    where nothing is taken.  With carry, the whole row comes along as the struct `row`; docs is then read twice instead of being
    written with its sizes, and must give the same rows, as a table does."""
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    row = [F.struct("*").alias("row")] * carry
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words_of(F.col(text)).alias("size"), h.alias("h"), *row)
    if not carry:
        sized = written(sized, "mix-sizes")
    # Buckets are prefixes of the hash, so they are ordered as the documents; their number follows the table.
    n = docs.count() if carry else sized.count()
    digits = max(1, min(7, len(f"{max(1, n // 4000):x}")))
    # A name that is never null, so that the join and the window below share one exchange of the rows.
    sized = sized.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).withColumn("bucket", F.substring("h", 1, digits))
    buckets = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("held")), "mix-buckets")
    wide = F.substring("bucket", 1, max(1, digits - 3))
    top = buckets.groupBy("source", wide.alias("top")).agg(F.sum("held").alias("top_held"))
    upto = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("top_before", F.coalesce(F.sum("top_held").over(upto(["source"], ["top"])), F.lit(0)))
    inside = buckets.withColumn("top", wide).withColumn("mid_before", F.coalesce(F.sum("held").over(upto(["source", "top"], ["bucket"])), F.lit(0)))
    b, t = inside.alias("b"), top.alias("t")
    before = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("b.top") == F.col("t.top"))).select(F.col("b.source").alias("source"), "bucket", (F.col("top_before") + F.col("mid_before")).alias("bucket_before"))
    targets = source_targets(buckets.select("source", F.col("held").alias("size")), weights, cap, share, tilts)
    s, g = before.alias("s"), targets.alias("g")
    plan = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.coalesce(F.concat(F.lit("="), F.col("s.source").cast("string")), F.lit("")).alias("name"), "bucket", "bucket_before", "source_size", "target", "tilt")
    placed = sized.join(plan, ["name", "bucket"], "left").select("key", "size", "name", "bucket", "h", "bucket_before", "source_size", "target", "tilt", *["row"] * carry)
    own = Window.partitionBy("name", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.col("bucket_before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    due = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(due / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = due - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    a = F.col("tilt")

    def at(copy: Column) -> Column:
        # Epoch `copy` reaches the document when copy - 1 whole epochs and `before` of the source's `target` tokens are behind it.
        behind = F.least(F.lit(1.0), ((copy - 1) * F.col("source_size") + F.col("before")) / F.col("target"))
        return F.when(a == 0, behind).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * behind)) / (2 * a))

    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = placed.withColumn("taken", taken.cast("long"))
    out = out.withColumn("position", F.when(F.col("taken") > 0, at(F.lit(1)))).withColumn("positions", F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(1), copies), at)))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "taken", "position", "positions", *["row"] * carry)


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """take() range-sorted by the position of the first copy; rows that the mix leaves out come last."""
    key = how.get("key", "doc_id")
    return take(docs, **how).orderBy(F.col("position").asc_nulls_last(), key)


def mixed(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of the mix itself, with the columns of docs, range-sorted by position.

    A document stands there once per whole epoch taken, and once more with its first words where an epoch takes it in part
    (these words joined by single spaces), each copy at its own place in training; documents of which nothing is taken are
    absent."""
    got = take(docs, text=text, carry=True, **how).where("taken > 0")
    rest = F.col("taken") % F.col("size")
    each = got.select("size", "taken", "row", F.size("positions").alias("copies"), F.posexplode("positions").alias("copy", "at"))
    part = (rest > 0) & (F.col("copy") + 1 == F.col("copies"))
    body = F.when(part, F.array_join(F.slice(words_of(F.col(f"row.{text}")), F.lit(1), rest.cast("int")), " ")).otherwise(F.col(f"row.{text}"))
    columns = [body.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return each.orderBy("at").select(*columns)
