"""Removal of long repeated passages with a logarithmic family of suffix arrays.

A byte goes if a WINDOW-byte string that covers it also starts in a document with a smaller id.

* Documents are packed into chunks, written once to the shared folder.  The anchor of a window is the place of its first least
  GRAM-byte hash, so equal windows have anchors at equal offsets; neighbouring windows with one anchor are a segment, one entry
  of the index: the text around the anchor.
* Anchors are counted over all chunks, in packed columns.  Segments whose anchor occurs in one chunk only have no match
  elsewhere and are not sent; a segment that a chunk holds many times is sent once with all its places.
* Anchors are dealt to shards.  A shard adds its segments batch by batch to a family of levels.  A batch gets a suffix array:
  its segments in byte order of the text from the anchor on.  It is scanned against every level: where neighbours in the merged
  order, and in the order of the reversed text before the anchor, agree on WINDOW bytes or more together, the windows they may
  share are compared byte by byte and the larger document's is marked.  Levels of one size class merge into the next.
* A shard takes the batches of FAN chunks at a time; what its family keeps is a batch of the next round, until one is left.  A
  passage that a third of all documents share therefore enters a shard once a chunk, and each further round once per FAN.

Nothing is sampled or capped.  Defined cases: a null text is empty; matches never cross documents; rows with one id never
remove each other's bytes; a row with a null id keeps all its bytes and removes none elsewhere; texts shorter than WINDOW
bytes keep everything; an empty table gives an empty result.  A chunk holds whole documents and needs about 12 bytes of memory
per byte of its texts, which bounds the longest document by a worker's memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, handed_back, trimmed, written

WINDOW, GRAM = 50, 16
#: Gram positions in a window, which is also the most windows of a segment; the windows hashed at a time.
WIDE, BLOCK = WINDOW - GRAM + 1, 1 << 16
#: Bytes of text in a chunk and per shard, chunks that a shard takes in one round, segments of a batch.
CHUNK, SHARD, FAN, BATCH = 8 << 20, 16 << 20, 4096, 1 << 16
#: Free bytes before and after a buffer, so that words can be read around every anchor.
PAD = 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_LONG, _BYTES = T.LongType(), T.BinaryType()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; _unpack() needs their types."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=4).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += out[-1].nbytes
    return out


def _padded(*parts: np.ndarray) -> np.ndarray:
    edge = np.zeros(PAD, np.uint8)
    return np.concatenate([edge, *parts, edge])


def _words(buf: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from every position as one number."""
    return np.ndarray(len(buf) - 7, kind, buf, strides=(1,))


def _mixed(h: np.ndarray, word: np.ndarray, odd) -> np.ndarray:
    h = (h ^ word) * odd
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, at=slice(None)) -> np.ndarray:
    """Hashes of the GRAM bytes from each position in `at`."""
    if isinstance(at, slice):
        return _mixed(_mixed(_ODD[2], words[: len(words) - 8], _ODD[0]), words[8:], _ODD[1]) * _ODD[3]
    return _mixed(_mixed(_ODD[2], words[at], _ODD[0]), words[at + 8], _ODD[1]) * _ODD[3]


_STEPS = (*range(0, WINDOW - 8, 8), WINDOW - 8)


def window_hashes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of the WINDOW bytes from each position in `at`."""
    h = _ODD[4]
    for i, d in enumerate(_STEPS):
        h = _mixed(h, words[at + d], _ODD[i % 4])
    return h


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the WINDOW bytes at a and at b are equal."""
    out = np.ones(len(a), bool)
    for d in _STEPS:
        out &= words[a + d] == words[b + d]
    return out


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.empty(0, np.int64)


def _heads(first: np.ndarray, n: int) -> np.ndarray:
    """The group start of each of n places, from the group starts."""
    return np.repeat(first, np.diff(np.append(first, n)))


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0]..start[0]+n[0]-1, start[1].., as one array."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _grouped(finger: np.ndarray, equal, exact) -> tuple[np.ndarray, np.ndarray]:
    """(order, group starts) of equal strings: equal fingerprints whose bytes agree, else numbers that exact() gives."""
    order = np.argsort(finger, kind="stable")
    first = _starts(finger[order])
    head = _heads(first, len(order))
    twin = np.flatnonzero(head != np.arange(len(order)))
    if len(twin) and not equal(order[twin], order[head[twin]]).all():
        names: dict[bytes, int] = {}
        finger = np.array([names.setdefault(s, len(names)) for s in exact()], np.int64)
        order = np.argsort(finger, kind="stable")
        first = _starts(finger[order])
    return order, first


def byte_order(keys: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of each new string) of n strings by their words, first words first; keys give the words of some strings."""
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    for word in keys:
        group = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        own, g = order[tied], group[tied]
        k = word(own)
        s = np.lexsort((k, g))
        order[tied] = own[s]
        k, g = k[s], g[s]
        new[tied[1:]] |= (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    return order, new


class Family:
    """Levels of segments, each in byte order from the anchor on.  A segment has `n` windows, the first at `at`, its anchor
    `left` bytes behind that; gone has a bit for each window that a smaller document holds."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, left: np.ndarray, n: np.ndarray, doc: np.ndarray):
        self.buf, self.words, self.big = buf, _words(buf), _words(buf, ">u8")
        self.at, self.left, self.n, self.doc = at, left.astype(np.int64), n.astype(np.int64), doc
        self.anchor = at + self.left
        self.full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
        self.gone = np.zeros(len(at), np.uint64)
        self.lead = np.arange(len(at))
        self.levels: list[np.ndarray] = []

    def _alive(self, e: np.ndarray) -> np.ndarray:
        return e[self.gone[e] != self.full[e]]

    def _ordered(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the suffix array of some segments, whether each has another gram than the one before it)."""
        keys = [lambda i, d=d: self.big[self.anchor[e[i]] + d].astype(np.uint64) for d in _STEPS]
        e = e[byte_order(keys, len(e))[0]]
        a, b = self.big[self.anchor[e]], self.big[self.anchor[e] + 8]
        return e, np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(e)]

    def _collapsed(self, e: np.ndarray) -> np.ndarray:
        """One segment of each string, of its smallest document; larger documents' are gone, the same document's follow it."""
        at, last = self.at[e], self.at[e] + self.n[e] - 1
        finger = _mixed(window_hashes(self.words, at) * _ODD[2], window_hashes(self.words, last), _ODD[1])
        equal = lambda x, y: (self.n[e[x]] == self.n[e[y]]) & _same(self.words, at[x], at[y]) & _same(self.words, last[x], last[y])
        order, first = _grouped(finger, equal, lambda: (self.buf[i : i + k + WINDOW - 1].tobytes() for i, k in zip(at.tolist(), self.n[e].tolist(), strict=True)))
        e = e[order]
        head = _heads(first, len(e))
        if not len(first) or len(first) == len(e):
            return e
        least = np.minimum.reduceat(self.doc[e], first)
        over = self.doc[e] > least[np.searchsorted(first, head)]
        self.gone[e[over]] = self.full[e[over]]
        # The first segment of the smallest document leads.
        place = np.where(over, len(e), np.arange(len(e)))
        chief = np.minimum.reduceat(place, first)[np.searchsorted(first, head)]
        follow = ~over & (chief != np.arange(len(e)))
        self.lead[e[follow]] = e[chief[follow]]
        return e[~over & ~follow]

    def _agree(self, e: np.ndarray, new: np.ndarray, lo: int, step: int) -> np.ndarray:
        """For segments in order, the most bytes that one has in common with a neighbour of its gram, from anchor + lo by step."""
        view = np.lib.stride_tricks.sliding_window_view(self.buf, WIDE - 1)
        pair = np.flatnonzero(~new)
        common = np.empty(len(pair), np.int64)
        for i in range(0, len(pair), BLOCK):
            at = self.anchor[e] if not i else at
            p = pair[i : i + BLOCK]
            differ = view[at[p] + lo][:, ::step] != view[at[p - 1] + lo][:, ::step]
            common[i : i + BLOCK] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDE - 1)
        out = np.full(len(e) + 1, -1, np.int64)
        out[pair] = common
        out[pair - 1] = np.maximum(out[pair - 1], common)
        return out[:-1]

    def _settle(self, e: np.ndarray) -> np.ndarray:
        """Mark what smaller documents among these segments hold; the segments that lead and are not gone, as a suffix array."""
        e, new = self._ordered(self._alive(self._collapsed(e)))
        if not len(e):
            return e
        more = ~new
        more[:-1] |= ~new[1:]
        some = e[more]
        if not len(some):
            return e
        new = new[more]
        right = self._agree(some, new, GRAM, 1) + GRAM
        # The same grams in the order of the text before them, read backwards.
        gram = np.cumsum(new)
        back = [lambda i, d=d: self.words[self.anchor[some[i]] - d].astype(np.uint64) for d in (8, 16, 24, 32, 40)]
        order, _ = byte_order([lambda i: gram[i], *back], len(some))
        g = gram[order]
        left = np.empty(len(some), np.int64)
        left[order] = self._agree(some[order], np.concatenate(([True], g[1:] != g[:-1])), 1 - WIDE, -1)
        # Window j starts left - j bytes before the anchor; it can be shared if that much agrees before it and the rest after.
        lo = np.maximum(0, self.left[some] - left)
        hi = np.minimum(self.n[some] - 1, self.left[some] - (WINDOW - right))
        near = np.flatnonzero(lo <= hi)
        self._compare(some[near], lo[near], hi[near])
        return self._alive(e)

    def _compare(self, e: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Windows lo..hi of each segment, those not gone: mark every one that a smaller document among them holds."""
        which, j = np.repeat(e, hi - lo + 1), _spread(lo, hi - lo + 1)
        left = (self.gone[which] >> j.astype(np.uint64)) & np.uint64(1) == 0
        which, j = which[left], j[left]
        if not len(j):
            return
        at = self.at[which] + j
        order, first = _grouped(window_hashes(self.words, at), lambda x, y: _same(self.words, at[x], at[y]), lambda: (self.buf[i : i + WINDOW].tobytes() for i in at.tolist()))
        least = np.repeat(np.minimum.reduceat(self.doc[which[order]], first), np.diff(np.append(first, len(order))))
        over = order[self.doc[which[order]] > least]
        np.bitwise_or.at(self.gone, which[over], np.uint64(1) << j[over].astype(np.uint64))

    def _first_words(self, e: np.ndarray) -> np.ndarray:
        return self.big[self.anchor[e]].astype(np.uint64)

    def add(self, e: np.ndarray) -> None:
        batch = self._settle(e)
        for i, level in enumerate(self.levels):
            # Merge scan: only segments whose first word stands on both sides can match.
            f, g = self._first_words(level), self._first_words(batch)
            if len(f) and len(g):
                mine, theirs = (x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y for x, y in ((g, f), (f, g)))
                self._settle(np.concatenate([level[mine], batch[theirs]]))
                self.levels[i], batch = self._kept(level), self._kept(batch)
        levels: list[np.ndarray] = []
        for x in sorted((x for x in [*self.levels, batch] if len(x)), key=len):
            if levels and len(levels[-1]).bit_length() >= len(x).bit_length():
                x = self._ordered(np.concatenate([levels.pop(), x]))[0]
            levels.append(x)
        self.levels = levels[::-1]

    def _kept(self, e: np.ndarray) -> np.ndarray:
        return self._alive(e[self.lead[e] == e])

    def finish(self) -> np.ndarray:
        """Segments that follow another take its marks; the leading segments that are not gone."""
        while True:
            up = self.lead[self.lead]
            if (up == self.lead).all():
                break
            self.lead = up
        self.gone |= self.gone[self.lead]
        return np.sort(np.concatenate([self._kept(x) for x in self.levels] or [np.empty(0, np.int64)]))

    def marks(self, e: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, length) of the runs of gone windows of some segments, whose first windows are at `at`, joined."""
        whole = self.gone[e] == self.full[e]
        part = np.flatnonzero(~whole & (self.gone[e] != 0))
        which, j = np.repeat(part, self.n[e[part]]), _spread(np.zeros(len(part), np.int64), self.n[e[part]])
        on = (self.gone[e[which]] >> j.astype(np.uint64)) & np.uint64(1) == 1
        return _joined(np.concatenate([at[whole], at[which[on]] + j[on]]), np.concatenate([self.n[e[whole]], np.ones(int(on.sum()), np.int64)]))


def _joined(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs sorted, those that touch or overlap as one."""
    if not len(first):
        return first.astype(np.int64), n.astype(np.int64)
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate((first + n)[order])
    cut = np.flatnonzero(np.concatenate(([True], first[1:] > end[:-1])))
    return first[cut], np.append(end[cut[1:] - 1], end[-1]) - first[cut]


def segments(buf: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, left) of the segments of a padded buffer's documents, in order; together they hold every window once."""
    words, total = _words(buf), int(len(buf) - PAD - WINDOW + 1)
    place, firsts = np.uint64((1 << 20) - 1), []
    ends = np.concatenate([start, start + windows])
    for lo in range(PAD, total, BLOCK):
        hi = min(total, lo + BLOCK)
        m = gram_hashes(np.ascontiguousarray(words[lo : hi + WIDE - 1 + 8])) & ~place
        m |= np.arange(len(m), dtype=np.uint64)  # the first of equal hashes
        span = 1
        while 2 * span <= WIDE:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        m = np.minimum(m[: len(m) - (WIDE - span)], m[WIDE - span :])[: hi - lo]
        change = np.ones(hi - lo, bool)
        change[1:] = m[1:] != m[:-1]
        change[ends[(ends >= lo) & (ends < hi)] - lo] = True
        at = np.flatnonzero(change)
        firsts.append(np.stack([at + lo, (m[at] & place).astype(np.int64) + lo]))
    if not firsts:
        return np.empty(0, np.uint8), np.empty(0, np.uint8)
    first, anchor = np.concatenate(firsts, axis=1)
    # A segment that goes on in the next block is one.
    own = np.searchsorted(start, first, "right") - 1
    keep = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | np.isin(first[1:], ends)))
    first, anchor, own = first[keep], anchor[keep], own[keep]
    n = np.diff(np.append(first, total))
    valid = (own >= 0) & (first < (start + windows)[own])
    return n[valid].astype(np.uint8), (anchor - first)[valid].astype(np.uint8)


class Chunk:
    """The texts of one chunk as a padded buffer and its segments; a row without an id has none."""

    def __init__(self, row: dict):
        raw = zstandard.ZstdDecompressor().decompress(row["blob"]) if row["blob"] else b""
        self.ids, sizes = row["ids"], np.array(row["sizes"], np.int64)
        self.buf = _padded(np.frombuffer(raw, np.uint8))
        self.sizes, self.start, self.windows = sizes, *_bounds(self.ids, sizes)

    def find(self, packed: bytes) -> None:
        self.n, self.left = _unpack(packed, np.uint8, np.uint8)
        n = self.n.astype(np.int64)
        seen, ends = np.cumsum(n) - n, np.cumsum(self.windows)
        own = np.searchsorted(ends, seen, "right")
        self.first = seen - (ends - self.windows)[own] + self.start[own]
        self.doc = np.array([0 if i is None else i for i in self.ids], np.int64)[own]
        # Least hashes are mixed again before their high bits name a shard.
        self.key = _mixed(gram_hashes(_words(self.buf), self.first + self.left), _ODD[4], _ODD[0]) * _ODD[2]

    def short(self, bits: int) -> np.ndarray:
        """The shard and 32 more bits of each segment's anchor: all that counting and dealing need."""
        return self.key >> np.uint64(32 - bits)


def _bounds(ids: list, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start in the padded buffer, number of windows) of each document."""
    known = np.array([i is not None for i in ids], bool)
    return np.cumsum(sizes) - sizes + PAD, np.where(known, np.maximum(0, sizes - (WINDOW - 1)), 0)


def _each(batch: pa.RecordBatch):
    """The rows of a batch one by one, so that one chunk at a time is held as Python objects."""
    names = batch.schema.names
    for i in range(len(batch)):
        yield {c: batch.column(j)[i].as_py() for j, c in enumerate(names)}


def _chunks(docs: DataFrame, key: str, text: str, carry: bool) -> DataFrame:
    """(chunk, ids, sizes, size, blob, found, rest): whole documents packed up to CHUNK bytes, compressed; found: their
    segments; rest: their other columns."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([T.StructField("chunk", _LONG), T.StructField("ids", T.ArrayType(_LONG)), T.StructField("sizes", T.ArrayType(_LONG)), T.StructField("size", _LONG), T.StructField("blob", _BYTES), T.StructField("found", _BYTES)])
    other = T.StructType([f for f in docs.schema.fields if f.name != text] if carry else [])
    if other.fields:
        schema.add("rest", T.ArrayType(other))
    kinds = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("size", pa.int64()), ("blob", pa.binary()), ("found", pa.binary())])
    if other.fields:
        kinds = kinds.append(pa.field("rest", pa.list_(to_arrow_type(other))))

    @trimmed
    def run(batches):
        part, seq, ids, texts, rest, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row():
            raw, sizes = b"".join(texts), [len(t) for t in texts]
            found = segments(_padded(np.frombuffer(raw, np.uint8)), *_bounds(ids, np.array(sizes, np.int64)))
            blob = zstandard.ZstdCompressor(level=3).compress(raw)
            return pa.RecordBatch.from_pylist([{"chunk": (part << 32) | seq, "ids": ids, "sizes": sizes, "size": size, "blob": blob, "found": _pack(*found), "rest": rest}], schema=kinds)

        for batch in batches:
            for i in range(len(batch)):
                t = batch.column(1)[i].as_py()
                ids.append(batch.column(0)[i].as_py())
                texts.append(t)
                rest.append(batch.column(2)[i].as_py() if other.fields else None)
                size += len(t)
                if size >= CHUNK or len(ids) >= 1 << 16:
                    yield row()
                    seq, ids, texts, rest, size = seq + 1, [], [], [], 0
        if ids:
            yield row()

    extra = [F.struct(*other.fieldNames()).alias("rest")] if other.fields else []
    return docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), *extra).mapInArrow(run, schema)


def _rows(schema, *columns):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f.dataType == _BYTES else pa.int64()) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


_STEP = T.StructType([T.StructField("shard", _LONG), T.StructField("chunk", _LONG), T.StructField("blob", _BYTES)])


def _counted(chunks: DataFrame, bits: int) -> DataFrame:
    """(chunk, masks): for each chunk a blob per shard with one bit per distinct anchor, set if another chunk has it too."""

    @trimmed
    def send(batches):
        for batch in batches:
            for x in _each(batch):
                c = Chunk(x)
                c.find(x["found"])
                found = np.unique(c.short(bits))
                shard = found >> np.uint64(32)
                cut = _starts(shard)
                parts = np.split(found.astype(np.uint32), cut[1:]) if len(cut) else []
                blobs = [_pack(p) for p in parts]
                del c, found, parts  # before the next chunk is read
                yield _rows(_STEP, shard[cut].astype(np.int64), np.full(len(cut), x["chunk"]), blobs)

    def count(table: pa.Table) -> pa.Table:
        lists = [_unpack(b, np.uint32)[0] for b in table.column("blob").to_pylist()]
        all_, n = np.concatenate(lists), np.array([len(x) for x in lists])
        order = np.argsort(all_, kind="stable")
        s = all_[order]
        twin = np.zeros(len(s), bool)
        equal = s[1:] == s[:-1]
        twin[1:] |= equal
        twin[:-1] |= equal
        back = np.empty(len(s), bool)
        back[order] = twin
        bits_ = [np.packbits(x).tobytes() for x in np.split(back, np.cumsum(n)[:-1])]
        return pa.table({"shard": table.column("shard"), "chunk": table.column("chunk"), "blob": pa.array(bits_, pa.binary())})

    masks = chunks.select("chunk", "ids", "sizes", "blob", "found").mapInArrow(send, _STEP).groupBy("shard").applyInArrow(count, _STEP)
    return masks.groupBy("chunk").agg(F.collect_list(F.struct("shard", "blob")).alias("masks"))


#: A blob of segments: chunk and place of each occurrence, then of each segment its occurrences, document, n, left and bytes.
_KINDS = (np.int64, np.int64, np.uint32, np.int64, np.uint8, np.uint8, np.uint8)


def _sent(family: Family, kept: np.ndarray, shard: np.ndarray, chunk: np.ndarray, pos: np.ndarray):
    """(shard, blob) per shard: the kept segments, whose shards are `shard`, with the places of all that follow them."""
    # Occurrences of a segment: it and its followers, sorted by the segment they follow.
    occ = np.argsort(family.lead, kind="stable")
    lead = family.lead[occ]
    lo, hi = np.searchsorted(lead, kept, "left"), np.searchsorted(lead, kept, "right")
    order = np.argsort(shard, kind="stable")
    cut = _starts(shard[order])
    for part in np.split(order, cut[1:]) if len(cut) else []:
        e, times = kept[part], (hi - lo)[part]
        at = occ[_spread(lo[part], times)]
        # Differences compress better than the numbers themselves.
        steps = np.diff(pos[at], prepend=np.int64(0)), times.astype(np.uint32), np.diff(family.doc[e], prepend=np.int64(0))
        yield int(shard[part[0]]), _pack(chunk[at], *steps, family.n[e].astype(np.uint8), family.left[e].astype(np.uint8), family.buf[_spread(family.at[e], family.n[e] + (WINDOW - 1))])


def _settled(chunks: DataFrame, masks: DataFrame, bits: int) -> DataFrame:
    """Rows of two kinds: with shard -1 the repeats inside a chunk, else the segments of a chunk that other chunks may hold."""

    @trimmed
    def run(batches):
        for batch in batches:
            for x in _each(batch):
                c = Chunk(x)
                c.find(x["found"])
                if not len(c.first):
                    continue
                found, index, times = np.unique(c.short(bits), return_inverse=True, return_counts=True)
                shared = np.zeros(len(found), bool)
                shard = (found >> np.uint64(32)).astype(np.int64)
                for m in x["masks"] or []:
                    lo, hi = np.searchsorted(shard, m["shard"], "left"), np.searchsorted(shard, m["shard"], "right")
                    shared[lo:hi] = np.unpackbits(np.frombuffer(m["blob"], np.uint8), count=hi - lo).astype(bool)
                own = np.flatnonzero(shared[index] | (times[index] > 1))
                if not len(own):
                    continue
                index = index[own]
                family = Family(c.buf, c.first[own], c.left[own], c.n[own], c.doc[own])
                for lo in range(0, len(own), BATCH):
                    family.add(np.arange(lo, min(len(own), lo + BATCH)))
                kept = family.finish()
                pos = c.first[own] - PAD
                shards, blobs = [-1], [_pack(*family.marks(np.arange(len(own)), pos))]
                kept = kept[shared[index[kept]]]
                for s, blob in _sent(family, kept, shard[index[kept]], np.full(len(own), x["chunk"]), pos):
                    shards.append(s)
                    blobs.append(blob)
                del c, family  # before the next chunk is read
                yield _rows(_STEP, shards, [x["chunk"]] * len(shards), blobs)

    joined = chunks.select("chunk", "ids", "sizes", "blob", "found").join(masks, "chunk", "left")
    return joined.select("chunk", "ids", "sizes", "blob", "found", "masks").mapInArrow(run, _STEP)


def _merged(rows: DataFrame) -> DataFrame:
    """One round: rows (shard, batch, group, blob) of a shard and group enter one family; the same two kinds of rows come out.

    Repeats that are settled already pass through, each chunk's as a group of its own, so that a step has one reader only."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            return table.select(["shard", "batch", "blob"]).rename_columns(_STEP.names)
        order = np.argsort(table.column("batch").to_numpy(), kind="stable")
        shard, group = table.column("shard")[0].as_py(), table.column("group")[0].as_py()
        parts = [_unpack(table.column("blob")[int(i)].as_py(), *_KINDS) for i in order]
        sizes = np.cumsum([len(p[2]) for p in parts])
        chunk, times, n, left = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 4, 5))
        pos, doc = (np.concatenate([np.cumsum(p[i]) for p in parts]) for i in (1, 3))
        buf = _padded(*[p[6] for p in parts])
        del parts
        width = n.astype(np.int64) + (WINDOW - 1)
        family = Family(buf, np.cumsum(width) - width + PAD, left, n, doc)
        lo = 0
        for hi in sizes.tolist():
            if hi - lo >= BATCH or hi == sizes[-1]:  # small batches enter together
                for at in range(lo, hi, 2 * BATCH):
                    family.add(np.arange(at, min(hi, at + 2 * BATCH)))
                lo = hi
        kept = family.finish()
        of = np.repeat(np.arange(len(times)), times)
        marked = np.flatnonzero(family.gone[of] != 0)
        marked = marked[np.argsort(chunk[marked], kind="stable")]
        cut = _starts(chunk[marked])
        shards, chunks, blobs = [], [], []
        for part in np.split(marked, cut[1:]) if len(cut) else []:
            shards.append(-1)
            chunks.append(int(chunk[part[0]]))
            blobs.append(_pack(*family.marks(of[part], pos[part])))
        # What follows another segment adds its places to it.
        top = family.lead[of]
        order = np.argsort(top, kind="stable")
        lo, hi = np.searchsorted(top[order], kept, "left"), np.searchsorted(top[order], kept, "right")
        at = order[_spread(lo, hi - lo)]
        if len(kept):
            shards.append(shard)
            chunks.append(group)
            blobs.append(_pack(chunk[at], np.diff(pos[at], prepend=np.int64(0)), (hi - lo).astype(np.uint32), np.diff(doc[kept], prepend=np.int64(0)), n[kept], left[kept], buf[_spread(family.at[kept], width[kept])]))
        del family, buf
        handed_back()
        return pa.Table.from_batches([_rows(_STEP, shards, chunks, blobs)])

    return rows.groupBy("shard", "group").applyInArrow(run, _STEP)


def _verdicts(chunks: DataFrame, n_chunks: int, bits: int) -> DataFrame:
    """(chunk, blobs): where in each chunk repeated windows start."""
    step = _settled(chunks, _counted(chunks, bits), bits)
    # Batches are numbered by a hash of their chunk, so that groups of FAN are even whatever the chunk ids are.
    groups, last = max(1, -(-n_chunks // FAN)), None
    batch = F.pmod(F.xxhash64("chunk"), F.lit(groups))
    while True:
        group = F.when(F.col("shard") < 0, F.col("chunk")).otherwise(batch)
        step = _merged(step.select("shard", F.col("chunk").alias("batch"), group.alias("group"), "blob"))
        if groups == 1:
            break
        step = written(step, "levels")
        if last is not None:
            dropped(last)
        last = step
        groups = -(-groups // FAN)
        batch = F.col("chunk") % groups
    found = step.where("shard < 0").select("chunk", "blob")
    return found.groupBy("chunk").agg(F.collect_list("blob").alias("blobs"))


def _covered(x: dict, size: int) -> np.ndarray:
    """Which bytes of a chunk go, from the places where repeated windows start."""
    runs = [_unpack(blob, np.int64, np.int64) for blob in x["blobs"] or []]
    if not runs:
        return np.zeros(size, bool)
    first, n = _joined(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] + (WINDOW - 1) for r in runs]))
    step = np.zeros(size + 1, np.int8)
    step[first] = 1
    step[first + n] = -1
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def _judged(docs: DataFrame, key: str, text: str, carry: bool) -> DataFrame:
    chunks = written(_chunks(docs, key, text, carry), "chunks")
    sizes = chunks.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    bits = max(1, min(24, ((sizes["size"] or 0) // SHARD).bit_length()))
    own = [c for c in chunks.columns if c not in ("size", "found")]
    return chunks.select(*own).join(_verdicts(chunks, sizes["n"], bits), "chunk", "left").select(*own, "blobs")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    schema = T.StructType([T.StructField(key, _LONG), T.StructField("n_bytes", _LONG), T.StructField("n_removed", _LONG), T.StructField("n_spans", _LONG), T.StructField("kept_sha256", T.StringType())])

    @trimmed
    def run(batches):
        for batch in batches:
            for x in _each(batch):
                c, rows, lo = Chunk(x), [], 0
                buf = c.buf[PAD:-PAD]
                gone, raw = _covered(x, len(buf)), buf.tobytes()
                for i, size in zip(c.ids, c.sizes.tolist(), strict=True):
                    own = gone[lo : lo + size]
                    if own.any():
                        kept = buf[lo : lo + size][~own].tobytes()
                        spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                    else:
                        kept, spans = raw[lo : lo + size], 0
                    rows.append((i, size, int(own.sum()), spans, hashlib.sha256(kept).hexdigest()))
                    lo += size
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return _judged(docs, key, text, False).select("ids", "sizes", "blob", "blobs").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with all their columns, the text without its repeated bytes.

    Where a cut falls inside a character, the bytes of it that stay are dropped from the text, which must be valid UTF-8; a
    null text becomes empty."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.schema
    shape = to_arrow_schema(schema)

    @trimmed
    def run(batches):
        for batch in batches:
            for x in _each(batch):
                c, rows, lo = Chunk(x), [], 0
                buf = c.buf[PAD:-PAD]
                gone = _covered(x, len(buf))
                for size, other in zip(c.sizes.tolist(), x["rest"], strict=True):
                    kept = buf[lo : lo + size][~gone[lo : lo + size]].tobytes().decode("utf-8", "ignore")
                    rows.append(other | {text: kept})
                    lo += size
                    if len(rows) >= 1024:
                        yield pa.RecordBatch.from_pylist(rows, schema=shape)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return _judged(docs, key, text, True).mapInArrow(run, schema)
