"""Byte-level BPE encoding and decoding over padded numpy matrices.

The pieces of a text (matches of the split pattern) are encoded separately.  Distinct new pieces of a batch are bucketed by
byte length and laid out as padded matrices of token ids; in every round each row merges its leftmost pair of least rank.
Ranks of pairs come from an open-addressing hash table held in numpy arrays, finished rows leave the matrix (compaction), and
a merge looks up its two new neighbours only.  Encoded pieces stay in a bounded cache of the Python worker.

Pieces of more than LONG bytes (a run of one class of characters) take the same merges from a heap, as the matrix costs
their length squared.  Defined cases: a null or empty text has no ids, and its digests are those of the empty string;
repeated rows are encoded alike; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trimmed

LONG = 512
#: Entries of a worker's cache of pieces; it is emptied when it reaches this size.
CACHE = 200_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the joined token, by hashing with linear probing."""

    def __init__(self, pairs: np.ndarray, joined: np.ndarray):
        size = 1 << max(4, int(2 * len(pairs)).bit_length())
        self.mask, self.shift = size - 1, np.uint64(64 - (size.bit_length() - 1))
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        slot, todo = self._slot(pairs), np.arange(len(pairs))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            # Of several pairs that want one free slot the last one written gets it; the others move on.
            self.keys[at[free]] = pairs[todo[free]]
            won = self.keys[at] == pairs[todo]
            self.values[at[won]] = joined[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined ids, NONE where a side is padding (negative) or the pair is no token."""
        shape = left.shape
        left, right = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[todo] << 32) | right[todo]
        slot = self._slot(key)
        while len(todo):
            seen = self.keys[slot]
            hit = seen == key
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (seen >= 0)
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & self.mask
        return out.reshape(shape)


def _ranges(kind: str) -> str:
    """The characters below U+10000 of a property, as the ranges of a class."""
    import regex

    runs = regex.findall(f"\\p{{{kind}}}+", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])))
    # A run of the string is one of code points too, unless it spans the surrogates.
    whole = [r for run in runs for r in ([run] if ord(run[-1]) - ord(run[0]) == len(run) - 1 else run)]
    return "".join(f"\\u{ord(r[0]):04x}-\\u{ord(r[-1]):04x}" for r in whole)


def plain_split(pattern: str):
    """findall of the pattern over texts below U+10000 by the re module, which looks classes up in a bitmap; None for a pattern
    with other escapes than \\p{}, \\s and \\S."""
    out, within = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part[0] == "\\":
            if part == "\\S" and within or part[:2] not in ("\\p", "\\s", "\\S"):
                return None
            own = _ranges(part[3:-1] if part[1] == "p" else "White_Space")
            part = own if within else f"[{'^' * (part == '\\S')}{own}]"
        else:
            within = part == "[" or within and part != "]"
        out.append(part)
    return re.compile("".join(out)).findall


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        space = "\\p{White_Space}"
        # \s and \S mean the Unicode property, inside and outside a class.
        self.split_any = regex.compile(pattern.replace("[^\\s", f"[^{space}").replace("\\S", f"[^{space}]").replace("\\s", space)).findall
        self.split_plain, self.beyond = plain_split(pattern), re.compile("[^\x00-\uffff]").search
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.name = {i: str(i) for i in self.token}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs, joined = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    joined.append(rank)
        self.pairs = PairTable(np.array(pairs, np.int64), np.array(joined, np.int32))
        self.pair_rank = dict(zip(pairs, joined, strict=True))
        #: Of each known piece, its ids joined by commas and its decoded bytes.
        self.cache: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        return self.split_any(text) if self.split_plain is None or self.beyond(text) else self.split_plain(text)

    def _rounds(self, rows: list[bytes], width: int) -> list[list[int]]:
        """The ids of pieces of at most `width` bytes: one padded matrix, one merge per row and round."""
        n = len(rows)
        ids = np.full((n, width + 1), -1, np.int32)
        lengths = np.fromiter(map(len, rows), np.int64, n)
        ids[np.arange(width + 1)[None, :] < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        out: list = [None] * n
        row = np.arange(n)
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(axis=1)  # the first of equal ranks is the leftmost
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                held = ids[done]
                real = held >= 0
                flat, ends = held[real].tolist(), np.cumsum(real.sum(axis=1)).tolist()
                for k, lo, hi in zip(row[done].tolist(), [0, *ends], ends, strict=False):
                    out[k] = flat[lo:hi]
                go = ~done
                row, ids, rank, at, best = row[go], ids[go], rank[go], at[go], best[go]
                if not len(row):
                    break
                used = int((ids >= 0).sum(axis=1).max()) + 1
                ids, rank = ids[:, :used], rank[:, : used - 1]
            r = np.arange(len(row))
            ids[r, at] = best
            # Close the gap: columns right of the merged pair move one to the left.
            w = ids.shape[1]
            column = np.arange(w)
            right = column[None, :] > at[:, None]
            moved = np.concatenate([ids[:, 1:], np.full((len(row), 1), -1, np.int32)], axis=1)
            ids = np.where(right, moved, ids)
            moved = np.concatenate([rank[:, 1:], np.full((len(row), 1), NONE, np.int32)], axis=1)
            rank = np.where(right[:, :-1], moved, rank)
            rank[r, at] = self.pairs.get(ids[r, at], ids[r, np.minimum(at + 1, w - 1)])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], ids[left, at[left]])
        return out

    def _heap(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, position) over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.pair_rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (h := before[i]) >= 0 and (s := rank(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > LONG:
                out[i] = self._heap(p)
            else:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, members in buckets.items():
            step = max(1, 262_144 // width)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                for i, ids in zip(part, self._rounds([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def learn(self, pieces: set[str]) -> None:
        """Put these pieces in the cache."""
        if len(self.cache) + len(pieces) > CACHE:
            self.cache.clear()
            self.decoded.clear()
        new = [p for p in pieces if p not in self.cache]
        name, token = self.name, self.token
        for p, ids in zip(new, self.encode_pieces([p.encode("utf-8") for p in new]), strict=True):
            self.cache[p] = ",".join([name[i] for i in ids])
            self.decoded[p] = b"".join([token[i] for i in ids])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        return [i for ids in self.encode_pieces([p.encode("utf-8") for p in pieces]) for i in ids]

    def digest(self, pieces: list[str]) -> tuple[int, str, str]:
        """(ids, sha256 of the ids, sha256 of the decoded bytes) of a text's pieces."""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for lo in range(0, len(pieces), CACHE // 2):  # a text may have more pieces than the cache holds
            part = pieces[lo : lo + CACHE // 2]
            try:
                found = ",".join(map(self.cache.__getitem__, part))
            except KeyError:
                unknown = set(part).difference(self.cache)
                self.learn(unknown if len(self.cache) + len(unknown) <= CACHE else set(part))
                found = ",".join(map(self.cache.__getitem__, part))
            n += found.count(",") + 1
            ids.update((("," if lo else "") + found).encode())
            decoded.update(b"".join(map(self.decoded.__getitem__, part)))
        return n, ids.hexdigest(), decoded.hexdigest()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Codec(ranks, pattern)


#: Texts whose new pieces are encoded together, and the characters after which a group is closed.
GROUP, GROUP_CHARS = 512, 4_000_000


def _groups(texts: list[str]):
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and hi - lo < GROUP and chars < GROUP_CHARS:
            chars += len(texts[hi])
            hi += 1
        yield texts[lo:hi]
        lo = hi


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row; the rank file is read on each worker from `path`."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @trimmed
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for group in _groups(texts):
                split = [own.split(t) for t in group]
                fresh = set().union(*split).difference(own.cache)
                if len(fresh) <= CACHE // 2:
                    own.learn(fresh)
                rows += map(own.digest, split)
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)


def token_ids(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) with the ids themselves."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    @trimmed
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)


def texts(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes) decoded from ids; an unknown id raises KeyError."""
    kind = encoded.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("bytes", T.BinaryType())])

    @trimmed
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            found = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=schema.names)

    return encoded.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(run, schema)
