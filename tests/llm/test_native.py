from __future__ import annotations

import random

import pytest
from compare import views
from pyspark.sql import functions as F

from tilewright.llm import mixing, quality_rules, queries, url_filter, warc


def repeated(words):
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(k for i in at for k in range(i, i + 8))
    return len(hit)


def test_ledger_equals_brute_force(docs, clash):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n\n a a\na a\n", " #*$%&|<>"]) for _ in range(150)]
    texts += ["", None, " \x0b\n", "x y " * 30_000, "É\u00a0É\u2003x"]
    df = quality_rules.ledger(clash(docs(texts)))
    for r in df.collect():
        t = texts[r.doc_id] or ""
        words = t.encode().split()
        assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeated(words)
        assert bool(r.failed & 1) == (len(words) < 20)
    assert quality_rules.ledger(docs([]).limit(0)).count() == 0


def test_policies_and_ablation(docs):
    led = quality_rules.ledger(docs(["a b", "word " * 5 + " ".join(f"w{i}" for i in range(40)), "# " * 50]))
    assert [r.kept for r in quality_rules.apply_policy(led, 1).orderBy("doc_id").collect()] == [False, True, False]
    ab = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(led, 2).collect()}
    assert ab["few_words"] == (1, 0) or ab["few_words"][0] == 1
    assert quality_rules.ablation(led.limit(0), 2).agg(F.sum("n_failed")).first()[0] == 0


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/x?q#f", "https://a.example.com/en/", "x://example.com/en", "https://EXAMPLE.com/e", "h://foo.net/es/1", "h://foo.net/fr/", "h://foo.net?/fr/", "nothing", None, "", "a://b://c/d", "://net/es/\n", "http://com", "http://notexample.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("x"), "key": F.lit("y"), "rule": F.lit("z"), "bound": F.lit(0)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2] == ("example.com", "/en", "com/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[5][2:] == ("net/fr/", "block") and got[6] == ("foo.net", "", None, "allow")
    assert got[7] == ("", "", None, "allow") == got[8] == got[9]
    assert got[10][:2] == ("b:", "//c/d") and got[11] == ("net", "/es/\n", "net/es/", "block")
    assert got[12] == ("com", "", None, "allow") and got[13][2:] == ("com/", "allow")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_bad_hosts_are_blocked_and_little_evidence_is_not(spark):
    rows = [(i, "h://bad.org/x" if i < 60 else "h://good.org/x" if i < 120 else "h://new.info/x", 0 if i < 60 else 1 if i < 120 else None) for i in range(130)]
    rows += [(200, "h://one.dev/", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, outcome int")
    out = {r.host: r.verdict for r in url_filter.judge(df.select("page_id", "url"), df.select("page_id", "outcome")).collect()}
    assert out == {"bad.org": "block", "good.org": "allow", "new.info": "allow", "one.dev": "allow"}


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, docs, clash, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))) or None, "", rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(400)]
    df = spark.createDataFrame(rows, docs([""]).schema)
    out = mixing.take(clash(df)).collect()
    assert len(out) == 400 and sorted(map(repr, out)) == sorted(map(repr, mixing.take(df).collect()))
    by = {r[0]: r[3] for r in rows}
    total = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        t = total.setdefault(by[r.doc_id], [0, r.target, r.source_size])
        t[0] += r.taken
    assert all(abs(t[0] - t[1]) <= 1 and t[1] <= 3 * t[2] for t in total.values())
    assert sum(t[1] for t in total.values()) == pytest.approx(sum(t[2] for t in total.values()))
    assert all((r.position is None) == (r.taken == 0) for r in out)
    mixed = mixing.mixed(df)
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert words == sum(r.taken for r in out) and mixed.columns == df.columns


def test_copies_follow_the_schedule_of_their_source(spark, docs):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 30))), "", "abc"[i % 3], 0) for i in range(900)]
    df = spark.createDataFrame(rows, docs([""]).schema)
    out = mixing.take(df).collect()
    by = {r[0]: r[3] for r in rows}
    target, tilt = {by[r.doc_id]: r.target for r in out}, dict(zip("abc", mixing.TILTS, strict=True))
    assert any(r.target > 1.5 * r.source_size for r in out)
    assert all(0 <= p <= 1 and r.position == r.positions[0] for r in out for p in r.positions or [])
    due = lambda s, t: target[s] * (t + tilt[s] * (t * t - t))
    seen = dict.fromkeys("abc", 0)
    # Wherever the stream is cut, every source has given what its schedule asks by then.
    for r in mixing.mixed(df).collect():
        seen[r.source] += len(r.text.split())
        lo, hi = 0.0, 1.0
        for _ in range(40):
            t = (lo + hi) / 2
            lo, hi = (t, hi) if sum(due(s, t) for s in "abc") < sum(seen.values()) else (lo, t)
        assert all(abs(seen[s] - due(s, lo)) < 100 for s in "abc")


def test_mix_of_nothing(docs):
    assert mixing.take(docs([]).limit(0)).count() == 0
    assert [(r["size"], r.target, r.taken) for r in mixing.take(docs(["", None])).collect()] == [(0, 0.0, 0)] * 2


def test_warc(spark):
    rows = [(1, "u1", "same"), (5, "u\r\n5", "same"), (3, None, "same"), (7, "u7", ""), (8, "u8", None), (9, "é", "é\n\r\n\r\nx"), (9, "é", "é\n\r\n\r\nx"), (None, "n", "alone"), (None, "n", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha256": F.lit("x"), "key": F.lit("y"), "payload": F.lit("z")})
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    assert got == sorted([(1, 4, "revisit", 5), (5, 4, "response", None), (3, 4, "revisit", 5), (7, 0, "revisit", 8), (8, 0, "response", None), (9, 8, "response", None), (9, 8, "response", None), (None, 5, "response", None), (None, 4, "revisit", 5)], key=repr)
    import base64
    import hashlib

    want = base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert want in {r.payload_digest for r in warc.round_trip(df).collect()}
    small = warc.round_trip(df, least=5).where("page_id = 1").first()
    assert small.record_type == "response"
    path = warc.new_path(spark, "t")
    warc.write(df, path)
    record = next(bytes(r.record) for r in warc.read(spark, path).collect() if b"<urn:page:5>" in bytes(r.record) and b"WARC-Type: response" in bytes(r.record))
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\nsame\r\n\r\n") and b"u%0D%0A5" in record
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    assert warc.round_trip(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    from tilewright.llm import knn

    rng = random.Random(3)
    vec = lambda: [rng.choice([-1.0, 0.25, 0.5, 1e-3, 0.7]) for _ in range(6)]
    rows = [(i, vec()) for i in range(300)] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, vec()), (7, vec()), (400, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "part": F.lit(3)})
    import math

    import numpy as np

    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in (0, 100, 200, 400):
        own = min(v for i, v in fine if i == q)
        hits = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in fine if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    for shard, leaf in ((8192, 64), (40, 4)):
        knn.SHARD, knn.LEAF, old = shard, leaf, (knn.SHARD, knn.LEAF)
        try:
            got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(df, df.where("vec_id % 100 = 0 and vec_id < 500")).collect())
        finally:
            knn.SHARD, knn.LEAF = old
        assert [g[:1] + g[1:2] + g[3:] for g in got] == [w[:1] + w[1:2] + w[3:] for w in sorted(want)]
        assert got == sorted(want)
    few = df.where("vec_id < 4")
    assert knn.top_k(few, few.where("vec_id = 0")).count() == 3
    assert knn.top_k(df.limit(0), df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, -1.0]), (2, [-2e6, 4.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in knn.top_k(big, big.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1024**2 * (6 * 10**12 - 1)), (2, 1024**2 * (-6 * 10**12 + 4))]


def test_top_k_by_cells_sends_nothing_through_the_driver(spark, monkeypatch):
    from tilewright.llm import knn

    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.25, 0.5, 0.7, 3e6 if i == 77 else 0.1]) for _ in range(5)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, n in (("SHARD", 40), ("BLOCK", 8), ("LEAF", 4), ("GROUP", 4), ("BAND", 16)):
        monkeypatch.setattr(knn, name, n)
    got = knn.top_k(df, df.where("vec_id % 10 = 0"))
    # A join that Spark may broadcast is collected by the driver, whatever its size turns out to be.
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    import math

    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = []
    for q, own in fine[::10]:
        hits = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in fine if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    assert sorted(map(tuple, got.collect())) == want


def test_queries_have_the_contract_columns(spark):
    assert views("/root/testdata/sf0.001").execute("SELECT count(*) FROM documents").fetchall()[0][0] == 200
    assert sorted(queries.QUERIES) == sorted(f"op{n}_" + queries_name for n, queries_name in ((1, "near_dedup"), (2, "quality_rules"), (3, "url_filter"), (4, "mixing"), (5, "quality_classifier"), (6, "top_k"), (7, "bpe"), (8, "suffix_dedup"), (9, "warc"), (10, "toxicity")))
