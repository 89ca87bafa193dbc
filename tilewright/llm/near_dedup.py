"""Near-duplicate groups by Fast Similarity Sketching, banding and exact verification.

1. sketches(): a text becomes its set of distinct word shingles (64-bit hashes).  In round i every element is placed into a
   hashed bin with a value that grows with i; rounds t..2t-1 place every element into bin i-t, so each of the t coordinates
   fills, and a document stops as soon as all are full.  Coordinates agree with probability equal to the Jaccard similarity,
   with the concentration of t independent samples.  Runs of `rows` coordinates are hashed into `bands` keys.
2. Documents with equal sets form a class, represented by its smallest id; only representatives are banded.
3. Every member of a bucket is verified against the bucket's smallest member (its pivot) on the full sets.  Links found are
   joined into components.
4. Members outside a bucket's largest component are compared with the members of other components, each pair once, at its
   smallest common key and only where it shares two keys or more; pairs that sizes, the triangle inequality of the Jaccard
   distance (through the pivot) or the sketches rule out are not emitted.  A bucket of SALTED members or more is dealt over
   several tasks.  So no bucket is capped and no group of copies is expanded into its pairs.

A pair at the threshold that shares fewer than two of the 40 band keys, or whose sketches differ in so many coordinates as
chance allows once in 10**5, is missed; pairs above the threshold are missed far less often.
Links need 100 * intersection >= threshold * union.  Words are runs of non-white-space, with A-Z lower-cased.

Defined cases: fewer words than k make one shingle, the whole sequence; a null, empty or blank text has the empty set, links
with nothing and is its own component; a null id takes part in no link and its component is null, kept; repeated rows are
judged row by row and have equal components; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, trimmed, written

#: Band keys, and coordinates of a sketch; the first bands * rows coordinates make the keys, all of them judge late pairs.
BANDS, SKETCH = 40, 640
#: The most rows a band may have is the largest for which a pair at the threshold shares fewer than two keys at most this often.
MISS = 1e-5
FULL = np.uint64(2**64 - 1)
#: Members of a bucket that one task compares others with.
SALTED = 1000
#: Late pairs that are judged at a time.
MEET = 1 << 18
#: Documents whose shingles are sketched together, and the words after which a group is closed.
GROUP, GROUP_WORDS = 512, 400_000


def band_rows(threshold: int, bands: int = BANDS) -> int:
    s, rows = threshold / 100, 1
    missed = lambda r: (1 - s**r) ** bands + bands * s**r * (1 - s**r) ** (bands - 1)
    while rows < 16 and missed(rows + 1) <= MISS:
        rows += 1
    return rows


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_sets(split: list[list[bytes]], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each word list."""
    sizes = [len(w) for w in split]
    flat = [w for ws in split for w in ws]
    if not flat:
        return [np.empty(0, np.uint64)] * len(split)
    h = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    out, lo = [], 0
    with np.errstate(over="ignore"):
        for n in sizes:
            own, lo = h[lo : lo + n], lo + n
            width = min(n, k)
            if not n:
                out.append(own)
                continue
            s = np.zeros(n - width + 1, np.uint64)
            for j in range(width):
                s = _mix(s * _STEP + own[j : n - width + 1 + j])
            s = np.sort(s + np.uint64(width))
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The t coordinates of each set; an empty set keeps FULL everywhere."""
    n = len(sets)
    s = np.full((n, t), FULL)
    element = np.concatenate(sets) if n else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(n), [len(x) for x in sets])
    flat = s.reshape(-1)
    low = np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(element):
                break
            x = _mix(element + np.uint64(i + 1) * _STEP)
            bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
            np.minimum.at(flat, doc * t + bins, (np.uint64(i) << np.uint64(32)) | (x & low))
            here = np.unique(doc) if i % 8 else np.arange(n)
            short = np.zeros(n, bool)
            short[here] = (s[here] == FULL).any(axis=1)
            go = short[doc]
            if not go.all():
                element, doc = element[go], doc[go]
    return s


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(s), axis=0)
        cut = s.reshape(len(s), bands, rows)
        for r in range(rows):
            key = _mix(key * _STEP + cut[:, :, r])
    return key.view(np.int64)


def nibbles(s: np.ndarray) -> np.ndarray:
    """The low four bits of every coordinate, sixteen to a long."""
    n, t = s.shape
    low = np.zeros((n, -(-t // 16) * 16), np.uint64)
    low[:, :t] = s & np.uint64(15)
    return np.bitwise_or.reduce(low.reshape(n, -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def most_differing(threshold: int, t: int) -> int:
    """The least number of differing nibbles that a pair at the threshold exceeds with a chance of MISS at most."""
    p, tail, m = (1 - threshold / 100) * 15 / 16, 1.0, 0
    while tail > MISS:
        tail -= math.comb(t, m) * p**m * (1 - p) ** (t - m)
        m += 1
    return m - 1


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row, the coordinates whose nibbles differ, by folding the bits of the exclusive or into the lowest of each nibble."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def _groups(lists: list, sizes, most: int, limit: int):
    lo = 0
    while lo < len(lists):
        hi, total = lo, 0
        while hi < len(lists) and hi - lo < most and total < limit:
            total += sizes(lists[hi])
            hi += 1
        yield lists[lo:hi]
        lo = hi


def sketches(docs: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, d1, d2, keys, bits): set size, 128-bit set digest, band keys and sketch nibbles, in one pass over the texts."""
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])
    lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1)))

    @trimmed
    def run(batches):
        for batch in batches:
            lo = 0
            for part in _groups(batch.column(1).to_pylist(), lambda x: len(x or "") // 5, GROUP, GROUP_WORDS):
                sets = shingle_sets([words(x) for x in part], k)
                found = sketch(sets, max(SKETCH, bands * rows))
                digest = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists(band_keys(found[:, : bands * rows], bands, rows)), lists(nibbles(found))], names=schema.names)
                lo += len(part)

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, both, either): exact intersection and union sizes of each pair's full sets.  texts: (id, text)."""
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("both", T.LongType()), T.StructField("either", T.LongType())])

    @trimmed
    def run(batches):
        last, held = None, None
        for batch in batches:
            ones, others = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            both, either, lo = [], [], 0
            for part in _groups(others, lambda x: len(x or "") // 5, GROUP, GROUP_WORDS):
                for other in shingle_sets([words(x) for x in part], k):
                    if (one := ones[lo]) != last:
                        last, held = one, shingle_sets([words(one)], k)[0]
                    common = len(np.intersect1d(held, other, assume_unique=True))
                    both.append(common)
                    either.append(len(held) + len(other) - common)
                    lo += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=schema.names)

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id of each node's component, for nodes with an edge; edges: (a, b).

    Alternates two star contractions: every node links its larger neighbours, then its smaller ones, to the smallest node it
    sees.  Degrees are only ever aggregated by min, so a star of any size is partially aggregated before its shuffle."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def state(e):
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    seen = state(now)
    while seen[0]:
        # Large star: u and its neighbours larger than u point to the smallest around u.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: among u's smaller neighbours and u itself, all point to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then = written(small, "edges")
        found = state(then)
        dropped(now)
        now = then
        if found == seen:
            break
        seen = found
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _sizes_fit(a: str, b: str, threshold: int):
    return F.expr(f"100 * least({a}, {b}) >= {threshold} * greatest({a}, {b})")


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0]..start[0]+n[0]-1, start[1].., as one array."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _met(t: pa.Table, threshold: int, most: int):
    """(index of x, index of y, block of x in its bucket) of the pairs to verify in whole buckets, which stand in order of key and
    salt, those with others to meet (role 0) before those that are met (role 1).  About MEET pairs are judged at a time."""
    flat = lambda c, kind: t.column(c).combine_chunks().flatten().to_numpy().view(kind).reshape(len(t), -1)
    key, salt, role, ids, comp, top, n, far = (t.column(c).to_numpy() for c in ("key", "salt", "role", "id", "comp", "top", "n", "far"))
    keys, bits = flat("keys", np.int64), flat("bits", np.uint64)
    cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))))
    group = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(t))))
    others = np.bincount(group, role, len(cut)).astype(np.int64)
    x = np.flatnonzero(role == 0)
    first = np.append(cut, len(t))[group[x] + 1] - others[group[x]]
    count = others[group[x]]
    done = np.cumsum(count)
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + MEET, "right")))
        i, j = np.repeat(x[lo:hi], count[lo:hi]), _runs(first[lo:hi], count[lo:hi])
        lo = hi
        fit = (comp[i] != comp[j]) & ((ids[i] < ids[j]) | (comp[j] == top[j])) & (100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
        i, j = i[fit], j[fit]
        # Two distances to a common pivot that differ by more than a link allows, with a margin for rounding; unknown ones are NaN.
        fit = ~(np.abs(far[i] - far[j]) > 1 - threshold / 100 + 1e-9)
        i, j = i[fit], j[fit]
        for at in range(0, len(i), MEET // 8):
            p, q = i[at : at + MEET // 8], j[at : at + MEET // 8]
            near = _differing(bits[p], bits[q]) <= most
            p, q = p[near], q[near]
            # A pair is judged at the smallest of its common keys, of which it has two or more.
            same = keys[p] == keys[q]
            least = np.where(same, keys[p], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            own = (same.sum(axis=1) > 1) & (least == key[p])
            yield p[own], q[own], (p[own] - cut[group[p[own]]]) // SALTED


def late_pairs(rest: DataFrame, threshold: int, most: int) -> DataFrame:
    """(a, b, place): pairs of members of a bucket that are in different components and may be links, each at one place.

    rest: key, id, n, comp, far, keys, bits, top, salts.  Members outside the bucket's largest component meet all others, which are
    dealt over salts; two of them meet once.  Buckets stream through in order and are judged many at a time."""
    kind = rest.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("key", T.LongType()), T.StructField("salt", T.IntegerType()), T.StructField("block", T.LongType())])

    @trimmed
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def judged(t: pa.Table):
            ids = t.column("id")
            for p, q, block in _met(t, threshold, most) if len(t) else ():
                if len(p):
                    x, y = ids.take(pa.array(p)).combine_chunks(), ids.take(pa.array(q)).combine_chunks()
                    at = pa.array(p)
                    yield pa.RecordBatch.from_arrays([x, y, t.column("key").take(at).combine_chunks(), t.column("salt").take(at).combine_chunks(), pa.array(block, pa.int64())], names=schema.names)

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            if held[0].column("key")[0].as_py() == key[-1] and held[0].column("salt")[0].as_py() == salt[-1]:
                continue
            t = pa.Table.from_batches(held)
            key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
            whole = int(np.flatnonzero((key != key[-1]) | (salt != salt[-1]))[-1]) + 1
            yield from judged(t.slice(0, whole))
            held = t.slice(whole).to_batches()
        if held:
            yield from judged(pa.Table.from_batches(held))

    own = ("id", "n", "comp", "far", "keys", "bits", "top")
    far = F.coalesce(F.col("far").cast("double"), F.lit(float("nan"))).alias("far")
    x = rest.where("comp <> top").select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), *own)
    y = rest.select("key", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), *own)
    dealt = x.unionByName(y).select("key", "salt", "role", *[far if c == "far" else c for c in own])
    found = dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "role").mapInArrow(run, schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.xxhash64("key", "salt", "block").alias("place"))


def verified_in_places(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """As verified(), for pairs (a, b, place) of which many at a place share their texts: each text goes to a place once, so a large
    group costs its texts and one intersection for each pair."""
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("both", T.LongType()), T.StructField("either", T.LongType())])

    @trimmed
    def run(batches):
        place, sets = None, {}
        for batch in batches:
            places, ids, others, texts_ = (batch.column(c).to_pylist() for c in ("place", "a", "b", "text"))
            made = {}
            held = [i for i, x in enumerate(others) if x is None]
            for part in _groups(held, lambda i: len(texts_[i] or "") // 5, GROUP, GROUP_WORDS):
                made.update(zip(part, shingle_sets([words(texts_[i]) for i in part], k), strict=True))
            out = []
            for i, (at, a, b) in enumerate(zip(places, ids, others, strict=True)):
                if at != place:
                    place, sets = at, {}
                if b is None:
                    sets[a] = made.pop(i)
                else:
                    common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    out.append((a, b, common, len(sets[a]) + len(sets[b]) - common))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field("a").type,) * 2 + (pa.int64(),) * 2, strict=True)], names=schema.names)

    sent = pairs.select("place", F.explode(F.array("a", "b")).alias("id")).distinct().join(texts, "id")
    rows = sent.select("place", F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "text").unionByName(pairs.select("place", "a", "b", F.lit(None).cast("string").alias("text")))
    return rows.repartition("place").sortWithinPartitions("place", F.col("b").asc_nulls_first()).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: int = 80, bands: int = BANDS) -> DataFrame:
    """(key, n_shingles, component_id, kept) per row."""
    rows = band_rows(threshold, bands)
    made = written(sketches(docs, key, text, k, bands, rows), "sketches")
    classes = made.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    chosen = made.alias("s").join(classes.alias("c"), F.expr("s.d1 = c.d1 and s.d2 = c.d2 and s.id = c.rep"), "left_semi").where("n > 0").dropDuplicates(["d1", "d2"])
    reps = written(chosen.select("id", "n", "keys", "bits"), "reps")
    members = reps.select("id", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("p")).where("c > 1").select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"))
    multi = written(members.join(shared, "key"), "buckets")
    involved = multi.select("id").distinct()
    texts = written(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(involved, "id", "left_semi"), "texts")

    stars = multi.where("id <> pivot").where(_sizes_fit("n", "pivot_n", threshold)).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    first = written(verified(stars, texts, k), "verified")
    linked = lambda v: v.where(f"100 * both >= {threshold} * either").select("a", "b")
    comps = written(components(linked(first)), "comps")

    # Buckets that still hold more than one component, and the component that most of their members are in.
    placed = multi.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    held = placed.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("top"), F.sum("c").alias("total"), F.count("*").alias("comps"))
    mixed = held.where("comps > 1").select("key", "top", F.ceil(F.col("total") / SALTED).cast("int").alias("salts"))
    distance = first.select(F.col("a").alias("pivot"), F.col("b").alias("id"), (1 - F.col("both") / F.col("either")).alias("far"))
    rest = placed.join(mixed, "key").join(distance, ["pivot", "id"], "left").withColumn("far", F.when(F.expr("id = pivot"), 0.0).otherwise(F.col("far")))
    rest = written(rest.join(reps.select("id", "keys", "bits"), "id").select("key", "id", "n", "comp", "far", "keys", "bits", "top", "salts"), "mixed")
    t = max(SKETCH, bands * rows)
    late = written(late_pairs(rest, threshold, most_differing(threshold, t)).join(first.select("a", "b"), ["a", "b"], "left_anti").dropDuplicates(["a", "b"]), "late")
    second = written(verified_in_places(late, texts, k), "verified")
    if not linked(second).isEmpty():
        comps = written(components(linked(first).unionByName(linked(second))), "comps")
    dropped(reps, multi, texts, first, rest, late, second)

    of_class = classes.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("d1", "d2", F.coalesce("comp", "rep").alias("comp"))
    found = made.select("id", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("comp")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of docs without those that are not their component's smallest id; rows with a null id stay."""
    gone = near_duplicates(docs, key=key, **how).where("not kept").select(key).distinct()
    return docs.join(gone, key, "left_anti").select(*docs.columns)


def expected_miss(threshold: int, bands: int = BANDS) -> float:
    """The chance that a pair exactly at the threshold shares fewer than two keys."""
    p = (threshold / 100) ** band_rows(threshold, bands)
    return math.pow(1 - p, bands) + bands * p * math.pow(1 - p, bands - 1)
