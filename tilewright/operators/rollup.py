"""Rollups over performance spans (study, scenario, seq, phase, ms, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
BLOCKING = ("render", "debug", "demand", "decode", "clamp", "labels")
FRAMES, MAX_SPANS, MAX_LONG_FRAMES, SLACK, QUIET_MS, SETTLE_MS = 60, 20_000, 500, 1.1, 400, 10_000


def phases(spans: DataFrame, by: tuple[str, ...] = ("phase",)) -> DataFrame:
    """count, total, max and nearest-rank p95 per phase, to two places."""
    two = lambda c, name: F.round(c, 2).alias(name)
    return spans.groupBy(*by).agg(F.count("*").alias("n"), two(F.sum("ms"), "total_ms"), two(F.max("ms"), "max_ms"), two(F.expr("percentile_disc(0.95) within group (order by ms)"), "p95_ms"))


def worst(spans: DataFrame, by: tuple[str, ...], blocking=BLOCKING) -> DataFrame:
    """The longest span of a blocking phase; the earliest of equals."""
    top = F.max_by(F.struct("phase", "ms", "seq"), F.struct("ms", -F.col("seq")))
    return spans.where(F.col("phase").isin(*blocking)).groupBy(*by).agg(top.alias("w")).select(*by, "w.phase", "w.seq", F.round("w.ms", 2).alias("ms"))


def busiest(spans: DataFrame, by: tuple[str, ...], blocking=BLOCKING) -> DataFrame:
    """The blocking phase with the largest total, the first by name of equals; without blocking, of all phases."""
    held = spans if blocking is None else spans.where(F.col("phase").isin(*blocking))
    t = held.groupBy(*by, "phase").agg(F.sum("ms").alias("total"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("total").desc(), "phase"))
    return t.withColumn("r", rank).where("r = 1").select(*by, "phase", F.round("total", 2).alias("total_ms"))


def rolling(spans: DataFrame, by: str, frames: int = FRAMES) -> DataFrame:
    """mean (of whole hundredths), max and nearest-rank p95 of the last `frames` spans at each span."""
    w = Window.partitionBy(by).orderBy("seq").rowsBetween(-(frames - 1), 0)
    held = spans.withColumn("held", F.sort_array(F.collect_list("ms").over(w)))
    at = F.ceil(F.size("held") * F.lit(0.95)).cast("int")
    total = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 100).cast("long"))
    return held.select(by, "seq", (total.cast("double") / (F.size("held") * F.lit(100.0))).alias("mean_ms"), F.element_at("held", -1).alias("max_ms"), F.element_at("held", at).alias("p95_ms"))


def regressions(worst_: DataFrame, baseline: DataFrame, budget: float, slack: float = SLACK) -> DataFrame:
    """key and state: within the budget, known (at most slack times the baseline) or failed."""
    both = worst_.join(baseline.select("key", F.col("ms").alias("known")), "key", "left")
    state = F.when(F.col("ms") <= budget, "ok").when(F.col("ms") <= F.col("known") * slack, "known").otherwise("failed")
    return both.select("key", "ms", state.alias("state"))


def retained(spans: DataFrame, by: str, most: int = MAX_SPANS) -> DataFrame:
    """The newest `most` spans of each log, the feature of a bounded log."""
    return spans.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.col("seq").desc()))).where(F.col("r") <= most).drop("r")


def quiet_sessions(spans: DataFrame, by: str, gap: str) -> DataFrame:
    """Runs of spans with no quiet stretch of `gap` inside: start, last span and count."""
    s = spans.groupBy(by, F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("spans"), F.max("ts").alias("last"))
    return s.select(by, F.col("w.start").alias("start"), "last", "spans")


def smoothed(targets: Column, step: float = 0.25, snap: float = 0.005) -> Column:
    """The alpha after each frame's step towards an ordered array of targets, landing when within snap."""

    def fold(held: Column, target: Column) -> Column:
        last = F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit(0.0))
        then = last + (target - last) * step
        return F.concat(held, F.array(F.when(F.abs(target - then) < snap, target).otherwise(then)))

    return F.aggregate(targets, F.array().cast("array<double>"), fold)
