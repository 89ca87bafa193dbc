"""Source descriptors and build plans: small TOML documents, validated on the driver, as DataFrames."""

from __future__ import annotations

import math
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.style import SOURCE_KINDS

DESCRIPTOR = "name string, kind string, url string, sha256 string, source_date string, licence string, attribution string, bounds struct<west:double,south:double,east:double,north:double>, adapter_version string"
LAYER = "layer_id int, descriptor string, input string, precedence int, west double, south double, east double, north double, min_level int, max_level int"
TERRAIN = "ordinal int, descriptor string, input string, stride int, west double, south double"
KEYS = ("name", "kind", "url", "sha256", "source_date", "licence", "attribution", "bounds", "adapter_version")


def descriptor(text: str) -> dict:
    """One descriptor; anything missing, insecure or out of range is an error."""
    try:
        s = tomllib.loads(text)["source"]
        missing = [k for k in KEYS if k not in s]
    except (tomllib.TOMLDecodeError, KeyError) as e:
        raise ValueError(f"no source descriptor: {e}") from e
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    if s["kind"] not in SOURCE_KINDS:
        raise ValueError("unknown kind")
    if not s["url"].startswith("https://"):
        raise ValueError("the url must be https")
    if not re.fullmatch("[0-9a-f]{64}", s["sha256"]):
        raise ValueError("the digest must be 64 lower-case hex digits")
    if not valid_box(s["bounds"]):
        raise ValueError("bounds out of range or order")
    return {k: s[k] for k in KEYS}


def valid_box(box) -> bool:
    if len(box) != 4 or not all(isinstance(v, (int, float)) and math.isfinite(v) for v in box):
        return False
    w, s, e, n = box
    return -180 <= w < e <= 180 and -90 <= s < n <= 90


def descriptors(spark: SparkSession, texts: list[str]) -> DataFrame:
    rows = [descriptor(t) for t in texts]
    return spark.createDataFrame([tuple(tuple(map(float, r[k])) if k == "bounds" else r[k] for k in KEYS) for r in rows], DESCRIPTOR)


def plan(spark: SparkSession, text: str, known: dict[str, dict]) -> tuple[DataFrame, DataFrame, float | None]:
    """(layers, terrains, terrain metres) of a plan; known: descriptors by the name the plan uses.

    A layer's box defaults to its descriptor's; a terrain needs a stride or a corner."""
    doc = tomllib.loads(text)
    layers = []
    for i, x in enumerate(doc.get("layer", [])):
        box = x.get("bounds") or known[x["descriptor"]]["bounds"]
        if not valid_box(box):
            raise ValueError("bounds out of range or order")
        layers.append((i, x["descriptor"], x["input"], x["precedence"], *map(float, box), *x["levels"]))
    terrains = []
    for i, x in enumerate(doc.get("terrain", [])):
        if "stride" not in x and not {"west", "south"} <= x.keys():
            raise ValueError(f"terrain {x['input']} needs a stride or a corner")
        if x.get("stride", 1) < 1:
            raise ValueError("stride must be at least 1")
        terrains.append((i, x["descriptor"], x["input"], x.get("stride"), x.get("west"), x.get("south")))
    return spark.createDataFrame(layers, LAYER), spark.createDataFrame(terrains, TERRAIN), doc.get("terrain_metres")


def verified(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (name, content) with `digest`; a file that differs from its descriptor's digest raises an error."""
    met = files.join(known.select("name", "sha256"), "name")
    digest = F.sha2("content", 256)
    return met.select("name", F.when(digest == F.col("sha256"), digest).otherwise(F.raise_error(F.concat(F.lit("checksum mismatch: "), "name"))).alias("digest"))
