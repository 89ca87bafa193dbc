from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tilewright.llm import near_dedup as nd


def brute(rows, k, threshold):
    """{id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= threshold * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = [rng.choice(words) for _ in range(40)]
    texts = []
    for i in range(n):
        kind = i % 8
        body = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        if kind < 3 and texts:
            body = rng.choice(texts).split()
            for _ in range(rng.randint(0, 6)):
                if body:
                    body[rng.randrange(len(body))] = rng.choice(words)
        elif kind == 3:
            body = common + body[:30]
        elif kind == 4:
            body = body[: rng.randint(0, 3)]
        texts.append(" ".join(body))
    return texts


@pytest.mark.parametrize(("k", "threshold", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_components_equal_brute_force(docs, clash, k, threshold, seed):
    texts = corpus(seed)
    want = brute(enumerate(texts), k, threshold)
    out = nd.near_duplicates(clash(docs(texts)), k=k, threshold=threshold)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_edge_cases(spark, docs):
    long = "a b c d e f g " * 20_000
    df = docs(["", None, " \n\t ", "One two", "one TWO", "x", long, long, "É é"]).union(spark.createDataFrame([(None, "one two", "", "", 0), (3, "One two", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, k=3, threshold=85).collect()), key=repr)
    by = defaultdict(set)
    for i, n, c, kept in got:
        by[i].add((n, c, kept))
    assert by[0] == {(0, 0, True)} and by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)}
    assert by[3] == {(1, 3, True)} and by[4] == {(1, 3, False)} and by[5] == {(1, 5, True)}
    assert by[6] == {(7, 6, True)} and by[7] == {(7, 6, False)}
    assert by[None] == {(1, None, True)}
    assert nd.near_duplicates(df.limit(0), k=3, threshold=85).count() == 0
    assert nd.deduplicated(df).columns == df.columns


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for n in (10, 20, 40, 1500):
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n * 9 // 10], pool[n : n + n // 10]]))
        s = nd.sketch([a, b, a], 400)
        assert not (s == nd.FULL).any() and (s[0] == s[2]).all()
        union = len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - (len(np.intersect1d(a, b)) / union if union else 0)) < 0.12
    assert (nd.sketch([np.empty(0, np.uint64)], 8) == nd.FULL).all()


def test_parameters_hold_their_promise():
    assert nd.expected_miss(85) <= nd.MISS and nd.expected_miss(80) <= nd.MISS
    s = np.arange(40, dtype=np.uint64).reshape(2, 20)
    assert nd.nibbles(s).shape == (2, 2)


def test_hardly_any_pair_at_the_threshold_is_missed():
    """Pairs with a similarity at or just above the threshold share two keys, and their sketches do not rule them out."""
    rng = np.random.default_rng(11)
    for threshold in (80, 85):
        rows = nd.band_rows(threshold)
        t = max(nd.SKETCH, nd.BANDS * rows)
        sets, missed, pairs = [], 0, 5200
        for _ in range(pairs):
            # both / (both + 2 * own) >= threshold / 100, as tightly as the sizes allow
            both = int(rng.integers(6, 90))
            own = int(both * (100 - threshold) // (2 * threshold))
            x = rng.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
            sets += [np.unique(x[: both + own]), np.unique(np.concatenate([x[:both], x[both + own :]]))]
        for lo in range(0, len(sets), 512):
            s = nd.sketch(sets[lo : lo + 512], t)
            keys, bits = nd.band_keys(s[:, : nd.BANDS * rows], nd.BANDS, rows), nd.nibbles(s)
            shared = (keys[::2] == keys[1::2]).sum(axis=1)
            x = bits[::2] ^ bits[1::2]
            differ = sum((((x >> np.int64(4 * j)) & np.int64(15)) != 0).sum(axis=1) for j in range(16))
            missed += int(((shared < 2) | (differ > nd.most_differing(threshold, t))).sum())
        assert missed <= 2


def test_a_large_bucket_is_dealt_over_salts(docs, monkeypatch):
    """Copies of one text with small edits, strays beside them, and salts of three members each."""
    monkeypatch.setattr(nd, "SALTED", 3)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = []
    for i in range(90):
        body = base[:]
        for _ in range(rng.choice([0, 1, 2, 6, 8])):
            body[rng.randrange(len(body))] = f"x{i}-{rng.randrange(100)}"
        texts.append(" ".join(body))
    for k, threshold in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs(texts), k=k, threshold=threshold).collect()}
        assert got == brute(enumerate(texts), k, threshold)


def test_late_pairs_in_blocks_equal_all_pairs(spark):
    rng = random.Random(5)
    threshold, most, bands = 85, 80, 6
    docs = [(i, rng.randrange(80, 120), rng.choice([0, 0, 0, i, 7]), rng.choice([None, 0.1, 0.2, 0.4])) for i in range(300)]
    keys = [[rng.randrange(5) + 10 * j for j in range(bands)] for _ in docs]
    bits = [[rng.choice([0, 0, 0, 1 << rng.randrange(62), -1 - (1 << 40)]) for _ in range(8)] for _ in docs]
    salts = {k: 1 + k % 3 for ks in keys for k in ks}
    rest = [(k, i, n, comp, far, keys[i], bits[i], 0, salts[k]) for i, n, comp, far in docs for k in keys[i]]

    def differ(x, y):
        return sum(1 for a, b in zip(x, y, strict=True) for s in range(0, 64, 4) if (((a ^ b) & (2**64 - 1)) >> s) & 15)

    want = set()
    for x, y in ((x, y) for x in docs for y in docs if x[2] != 0):
        common = [k for k, other in zip(keys[x[0]], keys[y[0]], strict=True) if k == other]
        once = x[2] != y[2] and (x[0] < y[0] or y[2] == 0) and 100 * min(x[1], y[1]) >= threshold * max(x[1], y[1])
        apart = x[3] is not None and y[3] is not None and abs(x[3] - y[3]) > 0.15 + 1e-9
        if once and not apart and len(common) > 1 and differ(bits[x[0]], bits[y[0]]) <= most:
            want.add((min(x[0], y[0]), max(x[0], y[0])))
    assert len(want) > 1000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(rest, "key long, id long, n long, comp long, far double, keys array<long>, bits array<long>, top long, salts int")
        late = nd.late_pairs(df, threshold, most).collect()
        assert sorted((r.a, r.b) for r in late) == sorted(want)
        texts = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(40))) for i, *_ in docs]
        made = nd.verified_in_places(spark.createDataFrame(late), spark.createDataFrame(texts, "id long, text string"), 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sets = {i: {tuple(w[j : j + 2]) for j in range(len(w) - 1)} for i, t in texts for w in [t.split()]}
    assert sorted(map(tuple, made)) == sorted((a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in want)
