"""Residency as streams: demand per session, arrivals, and quiet detection over spans.

State per session is its resident tiles, which a viewport and its margin bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import residency

TILE_STATE = "z int, x long, y long"
PLANNED = "session string, at timestamp, kind string, z int, x long, y long"


def _tiles(s) -> Iterator[tuple[int, int, int]]:
    top = (1 << s["z"]) - 1
    for y in range(max(s["y0"], 0), min(s["y1"], top) + 1):
        for x in range(max(s["x0"], 0), min(s["x1"], top) + 1):
            yield s["z"], x, y


class Planner(StatefulProcessor):
    """Per event: which tiles are missing, ahead, or to evict; what is missing counts as resident from then on.

    Events of one batch are taken in order of time; a burst therefore ends at its latest camera, and tiles asked for once are not
    asked for again while they stay resident."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.resident = handle.getMapState("resident", TILE_STATE, "known boolean", ttlDurationMs=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("at")
        held = {tuple(int(v) for v in k) for k in self.resident.keys()}
        before, out = set(held), []
        for e in events.itertuples(index=False):
            spans = [s.asDict() if hasattr(s, "asDict") else dict(s) for s in e.spans]
            target = [s for s in spans if s["role"] == "target"]
            ahead = [s for s in spans if s["role"] == "next" and e.zoom + residency.PREFETCH_ZOOM >= s["z"]]
            missing = [t for s in target for t in _tiles(s) if t not in held]
            early = [t for s in ahead for t in _tiles(s) if t not in held]
            m = residency.KEEP_MARGIN
            keep = lambda t: any(t[0] == s["z"] and s["x0"] - m <= t[1] <= s["x1"] + m and s["y0"] - m <= t[2] <= s["y1"] + m for s in spans)  # noqa: E731, B023
            gone = sorted(t for t in held if not keep(t))
            out += [(key[0], e.at, kind, *t) for kind, tiles in (("missing", missing), ("prefetch", early), ("evict", gone)) for t in tiles]
            held = held.difference(gone).union(missing, early)
        for t in before - held:
            self.resident.removeKey(t)
        for t in held - before:
            self.resident.updateValue(t, (True,))
        yield pd.DataFrame(out, columns=["session", "at", "kind", "z", "x", "y"])

    def close(self) -> None:
        pass


def demand(cameras: DataFrame, levels: list[int]) -> DataFrame:
    """Plan rows of a camera stream; sessions are strings."""
    events = residency.spanned(cameras, levels).select(F.col("session").cast("string").alias("session"), "at", "zoom", "spans")
    return events.groupBy("session").transformWithStateInPandas(Planner(), PLANNED, "Append", "None")


def first_requests(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests (path, at) without repeats of a path inside the watermark."""
    return requests.withWatermark("at", late).dropDuplicatesWithinWatermark(["path"])


def wanted_arrivals(arrivals: DataFrame, wanted: DataFrame) -> DataFrame:
    """Arrived tiles that the current demand (a static table) still wants; the others are dropped before decoding."""
    return arrivals.join(wanted, ["session", "z", "x", "y"], "left_semi")


def latest_cameras(batch: DataFrame) -> DataFrame:
    """One camera per session and micro-batch: a burst coalesces into its last event."""
    return batch.groupBy("session").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "session"]), "at").alias("c")).select("session", "c.*")


def quiet(spans: DataFrame, gap: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Sessions of spans that a quiet gap has ended: by study, with start, end and count."""
    s = spans.withWatermark("at", late).groupBy("study", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("spans"))
    return s.select("study", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spans")
