"""Label placement: a greedy fold per frame, and the questions asked of its result.

Candidates are (frame_id, class, fid, rank, text, ax, ay, w, h, repeats_by_text).  Placement depends on order, so a frame is one
group; a frame holds what a screen can show and its ring, which bounds it.  Pair queries use the cells a box touches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import style

# Fixed values.
CELL, MARGIN, REPEAT_RADIUS, BUDGET, WIDEST, PADDING = 64.0, 96.0, 260.0, 0.08, 400.0, 3.0
LABEL_SIZES, OTHER_SIZE = (20.0, 17.0, 15.0, 13.0), 12.0
PLACED = "frame_id int, class int, fid long, rank int, state string, blocked_class int, blocked_fid long, x0 float, y0 float, x1 float, y1 float"


def size_px(cls: Column, rank: Column) -> Column:
    label = F.element_at(F.array(*map(F.lit, LABEL_SIZES)), (F.least(rank, F.lit(3)) + 1).cast("int"))
    return F.when(cls == "Label", label).otherwise(F.lit(OTHER_SIZE))


def ready_zoom(cls: Column) -> Column:
    """Places and labels show from their entry; other names wait for the band after, the last band's for ever."""
    later = {b: (style.BANDS[i + 1][1] if i + 1 < len(style.BANDS) else float("inf")) for i, (b, _) in enumerate(style.BANDS)}
    of = {n: (style.ENTRY[b] if n in ("Label", "Poi") else later[b]) for _, n, b, *_ in style.CLASSES}
    return style.lookup(of, cls)


def boxes(c: DataFrame) -> DataFrame:
    half = lambda n: F.col(n).cast("float") / F.lit(2.0).cast("float")
    f = lambda n: F.col(n).cast("float")
    return c.withColumns({"x0": (f("ax") - half("w")).cast("float"), "y0": (f("ay") - half("h")).cast("float"), "x1": (f("ax") + half("w")).cast("float"), "y1": (f("ay") + half("h")).cast("float")})


def on_screen(width: float, height: float) -> Column:
    return F.expr(f"x1 > -{MARGIN} and y1 > -{MARGIN} and x0 < {width + MARGIN} and y0 < {height + MARGIN}")


def _fold(frame: pd.DataFrame, width: float, height: float, budget: float) -> pd.DataFrame:
    """One frame, in order of rank and identity; float32 throughout."""
    one = np.float32
    rows = frame.sort_values(["rank", "cls", "fid"], kind="stable").reset_index(drop=True)
    x0, y0, x1, y1 = (rows[c].to_numpy(np.float32) for c in ("x0", "y0", "x1", "y1"))
    screen = one(width) * one(height)
    allowed, used, spent = one(budget) * screen, one(0), False
    seen, cells, texts, state, by = set(), {}, {}, [], []
    for i, r in enumerate(rows.itertuples(index=False)):
        blocker = None
        identity = (r.cls, r.fid)
        near = range(int(np.floor(y0[i] / CELL)), int(np.floor(y1[i] / CELL)) + 1), range(int(np.floor(x0[i] / CELL)), int(np.floor(x1[i] / CELL)) + 1)
        keys = [(x, y) for y in near[0] for x in near[1]]
        if spent:
            said = "budget"
        elif not (x1[i] > -MARGIN and y1[i] > -MARGIN and x0[i] < width + MARGIN and y0[i] < height + MARGIN):
            said = "offscreen"
        elif identity in seen:
            said = "duplicate"
        elif r.repeats_by_text and r.text and any(np.hypot(one(r.ax) - a, one(r.ay) - b) <= one(REPEAT_RADIUS) for a, b in texts.get(r.text, ())):
            said = "repeat"
        else:
            seen.add(identity)
            hits = [j for k in keys for j in cells.get(k, ()) if x0[j] < x1[i] and x0[i] < x1[j] and y0[j] < y1[i] and y0[i] < y1[j]]
            clip = lambda v, top: min(max(v, one(0)), one(top))
            area = max(clip(x1[i], width) - clip(x0[i], width), one(0)) * max(clip(y1[i], height) - clip(y0[i], height), one(0))
            if hits:
                said, blocker = "collision", min(hits)
            elif used + area > allowed:
                said, spent = "budget", True
            else:
                said, used = "placed", used + area
                for k in keys:
                    cells.setdefault(k, []).append(i)
                texts.setdefault(r.text, []).append((one(r.ax), one(r.ay)))
        state.append(said)
        by.append(blocker)
    rows["state"] = state
    rows["blocked_class"] = pd.array([None if b is None else int(rows["cls"][b]) for b in by], "Int32")
    rows["blocked_fid"] = pd.array([None if b is None else int(rows["fid"][b]) for b in by], "Int64")
    return rows


def place(candidates: DataFrame, width: float, height: float, budget: float = BUDGET) -> DataFrame:
    """Every candidate with its state: placed, collision (and by whom), budget, offscreen, duplicate or repeat.

    After the first failure of the budget everything later is refused for the budget."""
    c = boxes(candidates).select("frame_id", F.col("class").alias("cls"), "fid", "rank", F.coalesce("text", F.lit("")).alias("text"), "ax", "ay", "repeats_by_text", "x0", "y0", "x1", "y1")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _fold(frame, width, height, budget).rename(columns={"cls": "class"})[["frame_id", "class", "fid", "rank", "state", "blocked_class", "blocked_fid", "x0", "y0", "x1", "y1"]]

    return c.groupBy("frame_id").applyInPandas(run, PLACED)


def cells(b: DataFrame, size: float = CELL) -> DataFrame:
    cell = lambda n: F.floor(F.col(n) / size).cast("int")
    return b.withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1")))).withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1"))))


def _classes(rows: DataFrame, *alike: str) -> DataFrame:
    """Rows that agree on `alike` as one: ids, the members of one input partition, so that no class is ever gathered whole."""
    return rows.where("id is not null").withColumn("part", F.spark_partition_id()).groupBy(*alike, "part").agg(F.collect_list("id").alias("ids")).drop("part")


def _paired(m: DataFrame, n: DataFrame, alike: tuple[str, ...], cell: tuple[str, ...], meet: Column) -> DataFrame:
    """Pairs (a, b) of members, a before b, of the classes of m and n that meet in a cell.

    Classes are merged, never broadcast: a small table can hold many pairs.  The exchange keeps all its partitions, as pairs are
    made behind it.  Unlike classes meet once, in one order; of a class with itself the members' own order keeps each pair once."""
    parts = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m, n = (x.repartition(parts, *cell).alias(k) for x, k in ((m, "m"), (n, "n")))
    key = lambda k: f"struct({', '.join(f'{k}.{c}' for c in alike)})"
    same = F.expr(f"{key('m')} = {key('n')}")
    on = F.expr(" and ".join(f"m.{c} = n.{c}" for c in cell)) & F.expr(f"{key('m')} <= {key('n')}") & meet
    met = m.join(n.hint("merge"), on).select(same.alias("same"), F.col("m.ids").alias("one"), F.col("n.ids").alias("two"))
    pairs = met.select("same", F.explode("one").alias("i"), "two").select("same", "i", F.explode("two").alias("j"))
    return pairs.where("i < j or (i > j and not same)").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def overlaps(b: DataFrame, key: str = "id") -> DataFrame:
    """Pairs (a, b) of boxes that overlap, a before b; edges that touch do not.

    Equal boxes are compared as one and expanded last; each pair of boxes is found in its first common cell."""
    corners = ("x0", "y0", "x1", "y1")
    at = cells(_classes(b.select(F.col(key).alias("id"), *corners), *corners))
    meet = F.expr("m.x0 < n.x1 and n.x0 < m.x1 and m.y0 < n.y1 and n.y0 < m.y1")
    lead = F.expr(f"m.cx = floor(greatest(m.x0, n.x0) / {CELL}) and m.cy = floor(greatest(m.y0, n.y0) / {CELL})")
    return _paired(at, at, corners, ("cx", "cy"), meet & lead)


def near_repeats(c: DataFrame, key: str = "id", radius: float = REPEAT_RADIUS) -> DataFrame:
    """Pairs of equal texts within the radius: equal text and a neighbouring cell of that size, then the distance.

    Labels of one text at one place are compared as one and expanded last."""
    alike = ("text", "ax", "ay")
    k = _classes(c.select(F.col(key).alias("id"), *alike).where("text <> ''"), *alike)
    cell = lambda n: F.floor(F.col(n) / radius).cast("int")
    home = k.withColumns({"cx": cell("ax"), "cy": cell("ay")})
    around = home.withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    near = F.hypot(F.col("m.ax") - F.col("n.ax"), F.col("m.ay") - F.col("n.ay")) <= radius
    return _paired(home, around, alike, ("text", "cx", "cy"), near)


def rank_inversions(placed: DataFrame) -> DataFrame:
    """Refused labels whose blocker is less important than they are; an invariant says none."""
    b = placed.where("state = 'placed'").select("frame_id", F.col("class").alias("blocked_class"), F.col("fid").alias("blocked_fid"), F.col("rank").alias("brank"))
    hit = placed.where("state = 'collision'").join(b, ["frame_id", "blocked_class", "blocked_fid"])
    return hit.where("struct(brank, blocked_class, blocked_fid) > struct(rank, class, fid)")


def churn(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """One row: share of placed labels that changed between two frames."""
    b, a = before.select(*on).distinct(), after.select(*on).distinct()
    both = b.withColumn("was", F.lit(1)).join(a.withColumn("now", F.lit(1)), on, "full")
    gone = F.count_if(F.col("was").isNull() | F.col("now").isNull())
    return both.agg(F.when(F.count("was") == 0, F.lit(0.0)).otherwise(gone / F.count("was")).alias("churn"))


def occupancy(placed: DataFrame, width: float, height: float) -> DataFrame:
    clip = lambda n, top: F.least(F.greatest(F.col(n), F.lit(0.0)), F.lit(float(top)))
    area = (clip("x1", width) - clip("x0", width)) * (clip("y1", height) - clip("y0", height))
    return placed.where("state = 'placed'").groupBy("frame_id").agg((F.sum(area) / (width * height)).alias("occupancy"))
