from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tilewright.llm import suffix_dedup as sd


def brute(rows):
    first, out = {}, {}
    for i, b in sorted(rows):
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared, out = [text(n) for n in (40, 60, 200, 49, 50)], []
    for _ in range(120):
        out.append("".join(rng.choice([text(rng.randint(0, 90)), rng.choice(shared), rng.choice(shared)[: rng.randint(30, 80)]]) for _ in range(rng.randint(0, 6))))
    return [*out, out[5], out[7], "z" * 300, "z" * 120, "", None]


@pytest.mark.parametrize("small", [False, True])
def test_removal_equals_brute_force(docs, clash, monkeypatch, small):
    if small:  # many chunks, shards and rounds
        monkeypatch.setattr(sd, "CHUNK", 400)
        monkeypatch.setattr(sd, "SHARD", 500)
        monkeypatch.setattr(sd, "FAN", 3)
        monkeypatch.setattr(sd, "BATCH", 40)
    texts = corpus(3 + small)
    want = brute([(i, (t or "").encode()) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(clash(docs(texts))).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 1000


def marked(rows, batch):
    """For each window of each row, as (document, place in the text): whether a family marks it."""
    buf = sd._padded(*[np.frombuffer(t, np.uint8) for _, t in rows])
    start, windows = sd._bounds([i for i, _ in rows], np.array([len(t) for _, t in rows], np.int64))
    n, left = sd.segments(buf, start, windows)
    assert n.astype(int).sum() == windows.sum()
    ends = np.cumsum(windows)
    seen = np.cumsum(n.astype(np.int64)) - n
    own = np.searchsorted(ends, seen, "right")
    at = seen - (ends - windows)[own] + start[own]
    doc = np.array([i for i, _ in rows], np.int64)[own]
    family = sd.Family(buf, at, left, n, doc)
    for lo in range(0, len(at), batch):
        family.add(np.arange(lo, min(len(at), lo + batch)))
    family.finish()
    first, count = family.marks(np.arange(len(at)), at)
    gone = np.zeros(len(buf), bool)
    gone[sd._spread(first, count)] = True
    return {(k, p): bool(gone[start[k] + p]) for k in range(len(rows)) for p in range(int(windows[k]))}, family


def repeated(rows):
    least = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            least[w] = min(i, least.get(w, i))
    return {(k, p): least[t[p : p + 50]] < i for k, (i, t) in enumerate(rows) for p in range(len(t) - 49)}


def edited(seed, letters, n=40):
    """Texts that share passages, are edited in places, run periodically and come in any order of documents."""
    rng = random.Random(seed)
    text = lambda k: bytes(rng.choice(letters) for _ in range(k))
    shared, rows = [text(rng.randint(45, 300)) for _ in range(5)] + [text(3) * 60, text(1) * 90], []
    for i in range(n):
        t = b"".join(rng.choice([text(rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 20) : rng.randint(40, 200)]]) for _ in range(rng.randint(0, 5)))
        t = bytearray(rng.choice(rows)[1]) if rows and rng.random() < 0.3 else bytearray(t)
        for _ in range(rng.randint(0, 2)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(letters)
        rows.append((rng.randrange(n), bytes(t)))
    return rows


@pytest.mark.parametrize("letters", [b"ab", b"abcdefghijklmnopqrstuvwxyz \n", bytes(range(256))])
@pytest.mark.parametrize("batch", [7, 150, 10_000])
def test_family_equals_brute_force(letters, batch):
    for seed in range(12):
        rows = edited(seed, letters)
        got, family = marked(rows, batch)
        assert got == repeated(rows)
        sizes = [len(x).bit_length() for x in family.levels]
        assert sizes == sorted(set(sizes), reverse=True)  # geometric levels


def test_levels_are_suffix_arrays():
    rows = edited(3, b"abcde")
    _, family = marked(rows, 50)
    for level in family.levels:
        suffixes = [family.buf[a : a + 50].tobytes() for a in family.anchor[level]]
        assert suffixes == sorted(suffixes)


def test_collisions_of_fingerprints_do_not_remove(monkeypatch):
    weak = sd.window_hashes
    monkeypatch.setattr(sd, "window_hashes", lambda words, at: weak(words, at) % np.uint64(7))
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab") for _ in range(200)).encode() for _ in range(6)]
    got, _ = marked(list(enumerate(rows + rows[:2])), 100)
    assert all(gone == (k >= 6) for (k, _), gone in got.items())


def test_edge_cases(spark, docs):
    df = docs(["x" * 100, "x" * 100]).union(spark.createDataFrame([(None, "x" * 100, "", "", 0), (1, "x" * 100, "", "", 0), (-3, "y" * 60, "", "", 0), (7, "y" * 60, "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = sorted(((r.doc_id, r.n_removed) for r in sd.remove_repeats(df).collect()), key=repr)
    assert got == sorted([(0, 0), (1, 100), (1, 100), (None, 0), (-3, 0), (7, 60)], key=repr)
    assert sd.remove_repeats(df.limit(0)).count() == 0
    rest = sd.without_repeats(df)
    assert rest.columns == df.columns and sorted(r.text for r in rest.collect())[:3] == ["", "", ""]


def test_workers_hand_back_what_they_freed():
    import os

    import numpy as np

    from tilewright.llm.common import trimmed

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE")

    @trimmed
    def run(batches):
        held = [np.ones(1000) for _ in range(20_000)]  # small arrays, which the C heap keeps
        pin = [np.ones(1000) for _ in range(4)]
        del held
        yield from batches
        del pin

    before = resident()
    assert list(run(iter([1, 2]))) == [1, 2]
    assert resident() - before < 40 << 20
    from tilewright.llm import bpe, near_dedup, suffix_dedup, toxicity

    assert all(m.trimmed is trimmed for m in (bpe, near_dedup, suffix_dedup, toxicity))
