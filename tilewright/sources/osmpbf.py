"""OpenStreetMap PBF files as a Python data source, one input partition per run of blobs.

spark.read.format("osmpbf").option("path", ..).load() gives elements (kind, id, lon, lat, nodes, members, tags).  Files are
opened through pyarrow's file systems, so any store that pyarrow reads will do.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, lon double, lat double, nodes array<long>, members array<struct<kind:string,ref:long,role:string>>, tags map<string,string>"
# Fixed values.
MAX_BLOB, KINDS = 32 << 20, ("node", "way", "relation")


def fields(data: bytes):
    """(number, value) of a protobuf message: integers, or bytes for length-delimited fields."""
    at, end = 0, len(data)
    while at < end:
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > end:
                raise ValueError("truncated message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("unknown wire type")
        yield number, value


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def packed(data, signed: bool = False) -> list[int]:
    if isinstance(data, int):
        return [data]
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for n, v in fields(data):
        out.setdefault(n, []).append(v)
    return out


def blob(data: bytes) -> bytes:
    m = message(data)
    if 1 in m:
        return m[1][0]
    if 3 in m:
        return zlib.decompress(m[3][0])
    raise ValueError("a compression that is not supported")


def elements(block: bytes):
    """Rows of one primitive block."""
    m = message(block)
    strings = [s.decode("utf-8", "replace") for s in message(m[1][0]).get(1, [])]
    grain, lat0, lon0 = (m.get(i, [d])[0] for i, d in ((17, 100), (19, 0), (20, 0)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    at = lambda lon, lat: ((signed(lon0) + grain * lon) * 1e-9, (signed(lat0) + grain * lat) * 1e-9)
    pairs = lambda e: {strings[k]: strings[v] for k, v in zip((x for d in e.get(2, []) for x in packed(d)), (x for d in e.get(3, []) for x in packed(d)), strict=False)}
    zig = lambda v: (v >> 1) ^ -(v & 1)
    for group in map(message, m.get(2, [])):
        for e in map(message, group.get(1, [])):
            yield ("node", zig(e[1][0]), *at(zig(e[9][0]), zig(e[8][0])), None, None, pairs(e))
        for d in map(message, group.get(2, [])):
            ids, lats, lons = (running(packed(d[i][0], True)) for i in (1, 8, 9))
            keys = iter(packed(d[10][0]) if 10 in d else [])
            for i, lat, lon in zip(ids, lats, lons, strict=True):
                tags = {}
                for k in keys:
                    if not k:
                        break
                    tags[strings[k]] = strings[next(keys)]
                yield ("node", i, *at(lon, lat), None, None, tags)
        for e in map(message, group.get(3, [])):
            yield ("way", signed(e[1][0]), None, None, running(packed(e[8][0], True)) if 8 in e else [], None, pairs(e))
        for e in map(message, group.get(4, [])):
            refs = running(packed(e[9][0], True)) if 9 in e else []
            roles, kinds = (packed(e[i][0]) if i in e else [] for i in (8, 10))
            members = [(KINDS[t], r, strings[s]) for t, r, s in zip(kinds, refs, roles, strict=True)]
            yield ("relation", signed(e[1][0]), None, None, None, members, pairs(e))


def opened(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def headers(source):
    """(offset of the blob, size, type) by hopping from header to header."""
    size = source.size()
    at = 0
    while at < size:
        source.seek(at)
        raw = source.read(4)
        if len(raw) < 4:
            raise ValueError("truncated file")
        (n,) = struct.unpack(">I", raw)
        head = message(source.read(n))
        length = head[3][0]
        if length > MAX_BLOB:
            raise ValueError("a blob beyond the format's limit")
        yield at + 4 + n, length, head[1][0].decode()
        at += 4 + n + length


class Blobs(InputPartition):
    def __init__(self, path: str, at: list[tuple[int, int]]):
        self.path, self.at = path, at


class Reader(DataSourceReader):
    def __init__(self, path: str, each: int):
        self.path, self.each = path, each

    def partitions(self):
        with opened(self.path) as source:
            found = [(a, n) for a, n, kind in headers(source) if kind == "OSMData"]
        return [Blobs(self.path, found[i : i + self.each]) for i in range(0, len(found), self.each)] or [Blobs(self.path, [])]

    def read(self, partition):
        with opened(partition.path) as source:
            for at, n in partition.at:
                source.seek(at)
                yield from elements(blob(source.read(n)))


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("blobs", 16)))


def tables(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, ways and relations of one scan."""
    return (
        found.where("kind = 'node'").select("id", "lon", "lat", "tags"),
        found.where("kind = 'way'").select("id", "nodes", "tags"),
        found.where("kind = 'relation'").select("id", "members", "tags"),
    )
