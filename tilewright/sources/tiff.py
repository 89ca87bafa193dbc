"""TIFF rasters as rows of chunks, so that a window reads only the chunks it meets.

Strips and tiles, uncompressed or deflate, horizontal predictor, one band of 16 or 32-bit integers or 32 or 64-bit floats.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .osmpbf import opened

SCHEMA = "row0 int, col0 int, h int, w int, samples array<float>"
# TIFF field types by code, and tags.
SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 12: "d", 13: "I", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, ROWS, STRIP_BYTES, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 278, 279, 317, 322, 323, 324, 325, 339
KINDS = {(16, 1): "u2", (16, 2): "i2", (32, 1): "u4", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}


def layout(source) -> dict:
    """Byte order, sample type and the chunks (row0, col0, h, w, offset, size) of the first image."""
    head = source.read(8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("no TIFF")
    source.seek(struct.unpack(order + "I", head[4:])[0])
    (n,) = struct.unpack(order + "H", source.read(2))
    entries = [struct.unpack(order + "HHI4s", source.read(12)) for _ in range(n)]
    tags = {}
    for tag, kind, count, raw in entries:
        if kind not in SIZES:
            continue
        size = struct.calcsize(order + SIZES[kind]) * count
        if size > 4:
            source.seek(struct.unpack(order + "I", raw)[0])
            raw = source.read(size)
        tags[tag] = struct.unpack(order + SIZES[kind] * count, raw[:size])
    one = lambda tag, other: tags.get(tag, (other,))[0]
    kind = KINDS.get((one(BITS, 1), one(FORMAT, 1)))
    if kind is None or len(tags[BITS]) > 1:
        raise ValueError("samples of a type that is not supported")
    if one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError("a compression that is not supported")
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    tiled = TILES in tags
    w, h = (tags[TILE_W][0], tags[TILE_H][0]) if tiled else (width, min(one(ROWS, height), height))
    across = -(-width // w)
    chunks = [(i // across * h, i % across * w, h, w, at, size) for i, (at, size) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True))]
    return {"width": width, "height": height, "kind": order + kind, "deflate": one(COMPRESSION, 1) != 1, "difference": one(PREDICTOR, 1) == 2, "tiled": tiled, "chunks": chunks}


def decoded(source, image: dict, chunk: tuple) -> tuple[int, int, np.ndarray]:
    """(row0, col0, samples as float32) of one chunk, cut to the image."""
    r, c, h, w, at, size = chunk
    source.seek(at)
    raw = source.read(size)
    raw = zlib.decompress(raw) if image["deflate"] else raw
    rows = h if image["tiled"] else min(h, image["height"] - r)
    v = np.frombuffer(raw, image["kind"], rows * w).reshape(rows, w)
    if image["difference"]:
        v = np.cumsum(v, axis=1, dtype=v.dtype)
    return r, c, v[: image["height"] - r, : image["width"] - c].astype(np.float32)


class Chunks(InputPartition):
    def __init__(self, path: str, image: dict, at: list):
        self.path, self.image, self.at = path, image, at


class Reader(DataSourceReader):
    """Options: path, and col0, row0, col1, row1 of a half-open pixel window; chunks outside it are never read."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.window = [int(options[k]) if k in options else None for k in ("col0", "row0", "col1", "row1")]
        self.each = int(options.get("chunks", 64))

    def partitions(self):
        with opened(self.path) as source:
            image = layout(source)
        c0, r0, c1, r1 = (d if v is None else v for v, d in zip(self.window, (0, 0, image["width"], image["height"]), strict=True))
        met = [c for c in image["chunks"] if c[0] < r1 and c[1] < c1 and c[0] + c[2] > r0 and c[1] + c[3] > c0]
        slim = {k: v for k, v in image.items() if k != "chunks"}
        return [Chunks(self.path, slim, met[i : i + self.each]) for i in range(0, len(met), self.each)] or [Chunks(self.path, slim, [])]

    def read(self, partition):
        with opened(partition.path) as source:
            for chunk in partition.at:
                r, c, v = decoded(source, partition.image, chunk)
                yield r, c, v.shape[0], v.shape[1], v.ravel().tolist()


class Tiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
