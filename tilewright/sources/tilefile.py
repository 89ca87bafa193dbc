"""Binary tiles: encoder, decoder, and packages of tile files as DataFrames.

Little-endian: magic, version, z, x, y, a section table (class, offset, length), payloads.  Vector sections hold features with
delta-coded vertices; classes from RASTER_BASE on are opaque rasters.  Versions 1 to 6 are read, 6 is written.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grid, style
from ..operators.parts import VERTICES, lists, point_lists, step_points

# Fixed values.
MAGIC, VERSION, OLDEST = b"MT2\0", 6, 1
BUILDINGS_FROM, HOLES_FROM, WIDE_IDS_FROM, MATERIAL_FROM = 2, 3, 4, 5
RASTER_BASE, HEIGHTS, HEIGHTS_PACKED = 0xFF00, 0xFF00, 0xFF01
TILE_BYTES = 4 << 20
# Features, and bytes of tiles, that one record batch holds at most before it is sent on.
BATCH_FEATURES, BATCH_BYTES = 4096, 8 << 20


class TileError(ValueError):
    """Bytes that are no tile, or a feature that a tile cannot hold."""


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _line(points) -> bytes:
    if not points:
        raise TileError("empty geometry")
    if len(points) > 0xFFFF:
        raise TileError("too many vertices")
    out = [struct.pack("<3H", len(points), *points[0])]
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        for d in (bx - ax, by - ay):
            out.append(_varint(2 * d if d >= 0 else -2 * d - 1))
    return b"".join(out)


def encode(z: int, x: int, y: int, features: list[dict], rasters: dict[int, bytes] | None = None) -> bytes:
    """features in section order: class, id, flags, rank, name, vertices, holes and building (base_dm, top_dm, roof, material)."""
    sections: dict[int, list[bytes]] = {}
    for f in features:
        b = f.get("building")
        low, top, roof, material = (b["base_dm"], b["top_dm"], style.ROOFS.index(b["roof"]), style.MATERIALS.index(b["material"])) if b else (0, 0, 0, 0)
        if b and top and top <= low:
            raise TileError("a building must rise above its base")
        name, holes = f.get("name", "").encode(), f.get("holes") or []
        if len(name) > 0xFFFF or len(holes) > 0xFFFF:
            raise TileError("too large")
        head = struct.pack("<QBBHHBBH", f["id"], f.get("flags", 0), f.get("rank", 0), low, top, roof, material, len(name))
        sections.setdefault(f["class"], []).append(head + name + _line(f["vertices"]) + struct.pack("<H", len(holes)) + b"".join(map(_line, holes)))
    if any(len(s) > 0xFFFF for s in sections.values()):
        raise TileError("too many features")
    payloads = [(c, struct.pack("<H", len(s)) + b"".join(s)) for c, s in sections.items()] + list((rasters or {}).items())
    table, at = [], 0
    for c, p in payloads:
        table.append(struct.pack("<HII", c, at, len(p)))
        at += len(p)
    return MAGIC + struct.pack("<HBBIIHH", VERSION, z, 0, x, y, len(payloads), 0) + b"".join(table) + b"".join(p for _, p in payloads)


class Reader:
    """A cursor that turns any read past the end into TileError."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, shape: str):
        n = struct.calcsize(shape)
        if self.at + n > len(self.data):
            raise TileError("truncated")
        self.at += n
        return struct.unpack_from(shape, self.data, self.at - n)

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise TileError("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def signed(self) -> int:
        n = 0
        for shift in range(0, 35, 7):
            (b,) = self.take("<B")
            if shift == 28 and b > 15:
                raise TileError("bad varint")
            n |= (b & 127) << shift
            if b < 128:
                return n >> 1 if n % 2 == 0 else -(n >> 1) - 1
        raise TileError("bad varint")

    def line(self) -> list[tuple[int, int]]:
        (n,) = self.take("<H")
        if not n:
            raise TileError("truncated")
        out = [self.take("<2H")]
        for _ in range(n - 1):
            p = (out[-1][0] + self.signed(), out[-1][1] + self.signed())
            if not (0 <= p[0] <= 0xFFFF and 0 <= p[1] <= 0xFFFF):
                raise TileError("delta out of range")
            out.append(p)
        return out


def sections(data: bytes) -> tuple[int, tuple[int, int, int], list[tuple[int, bytes]]]:
    """(version, (z, x, y), [(class, payload)]); payloads are not decoded."""
    r = Reader(data)
    if r.raw(4) != MAGIC:
        raise TileError("bad magic")
    version, z, _, x, y, n, _ = r.take("<HBBIIHH")
    if not OLDEST <= version <= VERSION:
        raise TileError("unknown version")
    table = [r.take("<HII") for _ in range(n)]
    base, out = r.at, []
    for c, at, size in table:
        if base + at + size > len(data):
            raise TileError("truncated")
        out.append((c, data[base + at : base + at + size]))
    return version, (z, x, y), out


def features(payload: bytes, version: int):
    """The features of a vector section."""
    r = Reader(payload)
    (n,) = r.take("<H")
    for _ in range(n):
        (fid,) = r.take("<Q" if version >= WIDE_IDS_FROM else "<I")
        flags, rank = r.take("<BB")
        building = None
        if version >= BUILDINGS_FROM:
            low, top, roof = r.take("<HHB")
            (material,) = r.take("<B") if version >= MATERIAL_FROM else (0,)
            if roof >= len(style.ROOFS) or material >= len(style.MATERIALS) or ((low or top) and top <= low):
                raise TileError("bad building")
            if low or top:
                building = {"base_dm": low, "top_dm": top, "roof": style.ROOFS[roof], "material": style.MATERIALS[material]}
        (size,) = r.take("<H")
        try:
            name = r.raw(size).decode()
        except UnicodeDecodeError as e:
            raise TileError("bad text") from e
        vertices = r.line()
        holes = [r.line() for _ in range(r.take("<H")[0])] if version >= HOLES_FROM else []
        yield {"id": fid, "flags": flags, "rank": rank, "name": name, "building": building, "vertices": vertices, "holes": holes}


FEATURE = f"path string, z int, x int, y int, class int, id long, flags int, rank int, name string, building struct<base_dm:int,top_dm:int,roof:string,material:string>, vertices {VERTICES}, holes array<{VERTICES}>, pos int"
RASTER = "path string, z int, x int, y int, class int, content binary"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a package's tile files, path relative as z/x/y.mt2; other files are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mt2").load(path)
    part = F.regexp_extract("path", "([0-9]+/[0-9]+/[0-9]+\\.mt2)$", 1)
    return found.select(part.alias("path"), "content").where("path <> ''")


def decoded(tiles: DataFrame, classes: list[int] | None = None) -> DataFrame:
    """The features of tiles (path, content) with their place in the tile, counted over the sections that are asked for; other
    sections are skipped undecoded."""
    wanted = None if classes is None else set(classes)
    schema = T._parse_datatype_string(FEATURE)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        plain = [n for n in shape.names if n not in ("vertices", "holes")]

        def batch_of(rows):
            own = {n: pa.array([r[n] for r in rows], shape.field(n).type) for n in plain}
            own |= {"vertices": lists([r["vertices"] for r in rows], step_points), "holes": lists([r["holes"] for r in rows], lambda rs: lists(rs, step_points))}
            return pa.RecordBatch.from_arrays([own[n].cast(shape.field(n).type) for n in shape.names], schema=shape)

        for batch in batches:
            rows = []
            for i in range(len(batch)):
                path = batch.column(0)[i].as_py()
                version, (z, x, y), parts = sections(batch.column(1)[i].as_py())
                pos = 0
                for c, payload in parts:
                    if c < RASTER_BASE and (wanted is None or c in wanted):
                        for f in features(payload, version):
                            rows.append(f | {"path": path, "z": z, "x": x, "y": y, "class": c, "pos": pos})
                            pos += 1
                            if len(rows) >= BATCH_FEATURES:
                                yield batch_of(rows)
                                rows = []
            if rows:
                yield batch_of(rows)

    return tiles.select("path", "content").mapInArrow(run, schema)


def rasters(tiles: DataFrame) -> DataFrame:
    """Height rasters of tiles, unpacked; a packed raster is preferred to a plain one."""
    schema = T._parse_datatype_string(RASTER)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from ..operators import raster

        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, (z, x, y), parts = sections(data)
                held = dict(parts)
                if HEIGHTS_PACKED in held:
                    content = raster.unpack(held[HEIGHTS_PACKED])
                elif HEIGHTS in held:
                    content = held[HEIGHTS]
                else:
                    continue
                rows.append({"path": path, "z": z, "x": x, "y": y, "class": HEIGHTS, "content": content})
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    return tiles.select("path", "content").mapInArrow(run, schema)


TILE = "z int, x int, y int, path string, content binary, features long"


def built(parts: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """Tiles (z, x, y, path, content, features) from parts; features by (class code, id), equal ones by layer and ordinal.

    parts: z, x, y, class (name), id, flags, rank, name, building, vertices, holes and optionally layer_id and ordinal.  Parts
    stream through in order, so a task holds one tile, whose size is what one file may hold, and not the tiles of a batch.
    heights: (z, x, y, packed) rasters for some of the tiles, one a tile."""
    spark_class = style.class_code(F.col("class"))
    p = parts.withColumn("code", spark_class)
    for c in ("layer_id", "ordinal"):
        if c not in p.columns:
            p = p.withColumn(c, F.lit(0))
    order = ["code", "id", "layer_id", "ordinal"]
    own = [*order, "flags", "rank", "name", "building", "vertices", "holes"]
    tile = ["z", "x", "y"]
    p = p.select(*tile, F.lit(None).cast("binary").alias("packed"), *own)
    if heights is not None:
        p = p.unionByName(heights.select(*tile, "packed").where("packed is not null"), allowMissingColumns=True)
    # A raster stands before its tile's parts.
    tiles = p.repartition(*tile).sortWithinPartitions(*tile, F.col("packed").isNull(), *order)
    schema = T._parse_datatype_string(TILE)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        at, made, packed, out, size = None, [], None, [], 0

        def ended():
            """The bytes of the tile that was read to its end, if it has parts."""
            if not made:
                return 0
            data = encode(*at, made, {HEIGHTS_PACKED: packed} if packed else None)
            out.append({"z": at[0], "x": at[1], "y": at[2], "path": f"{at[0]}/{at[1]}/{at[2]}.mt2", "content": data, "features": len(made)})
            return len(data)

        for batch in batches:
            plain = {n: batch.column(n).to_pylist() for n in (*tile, "packed", "code", "id", "flags", "rank", "name", "building")}
            vertices, holes = point_lists(batch.column("vertices")), point_lists(batch.column("holes"))
            for i, key in enumerate(zip(plain["z"], plain["x"], plain["y"], strict=True)):
                if key != at:
                    size += ended()
                    at, made, packed = key, [], None
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=shape)
                        out.clear()
                        size = 0
                if plain["packed"][i] is not None:
                    packed = plain["packed"][i]
                else:
                    made.append({"class": plain["code"][i], "id": plain["id"][i], "flags": plain["flags"][i], "rank": plain["rank"][i], "name": plain["name"][i] or "", "building": plain["building"][i], "vertices": vertices[i], "holes": [h or [] for h in holes[i] or []]})
        ended()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return tiles.mapInArrow(run, schema)


def _summed(features: DataFrame, code, order: list, names: list[str]) -> DataFrame:
    """(z, x, y, features, vertices, digest) of each tile, the last three named by names; digest is one SHA-256 over those of the
    features in order, each over all that a tile holds of a feature.  Only digests are shuffled."""
    name, holes = F.coalesce("name", F.lit("")), F.transform(F.coalesce("holes", F.array()), lambda h: F.coalesce(h, F.array()))
    whole = F.struct(code.alias("class"), "id", "flags", "rank", name.alias("name"), "building", "vertices", holes.alias("holes"))
    n = F.size("vertices") + F.aggregate(holes, F.lit(0), lambda s, h: s + F.size(h))
    own = features.select("z", "x", "y", n.cast("long").alias("n"), F.struct(*order, F.sha2(F.to_json(whole), 256).alias("digest")).alias("at"))
    lines = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list("at")), lambda r: r["digest"]))
    return own.groupBy("z", "x", "y").agg(*(c.alias(k) for c, k in zip((F.count("*"), F.sum("n"), F.sha2(lines, 256)), names, strict=True)))


def compared(parts: DataFrame, tiles: DataFrame) -> DataFrame:
    """Parts against tiles (as of built()) and what is decoded from them, tile by tile: features as the tiles tell them and as
    decoded, whether all is the same, and parts, vertices (those of holes too) and digests of both sides.  A tile that one side
    lacks has a row, and is not the same."""
    code = style.class_code(F.col("class"))
    order = [code.alias("code"), "id", *(F.col(c) if c in parts.columns else F.lit(0).alias(c) for c in ("layer_id", "ordinal"))]
    want = _summed(parts, code, order, ["parts", "vertices", "digest"])
    back = _summed(decoded(tiles), F.col("class"), ["pos"], ["decoded", "vertices_decoded", "digest_decoded"])
    same = F.expr("parts <=> features and parts <=> decoded and vertices <=> vertices_decoded and digest <=> digest_decoded")
    tile = ["z", "x", "y"]
    met = want.join(tiles.select(*tile, "features"), tile, "full").join(back, tile, "full").withColumn("same", same)
    return met.select(*tile, "features", "decoded", "same", "parts", "vertices", "vertices_decoded", "digest", "digest_decoded")


def written(tiles: DataFrame, folder: str) -> DataFrame:
    """Write each tile to folder/z/x/y.mt2 through pyarrow's file systems; returns (path, digest, bytes) of what was written."""
    schema = T._parse_datatype_string("path string, digest string, bytes long")

    def run(batches):
        import hashlib

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(data) > TILE_BYTES:
                    raise ValueError(f"{path} has {len(data)} bytes, a tile may have {TILE_BYTES}")
                store.create_dir(f"{root}/{path.rpartition('/')[0]}", recursive=True)
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(data)
                rows.append((path, hashlib.sha256(data).hexdigest(), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=schema.names)

    return tiles.select("path", "content").mapInArrow(run, schema)


def address(path) -> dict:
    return grid.parse_path(path)
