from __future__ import annotations

import base64
import hashlib
import re

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from test_near_dedup import brute as groups
from test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250").cache()
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["toxicity", "near-dedup", "suffix-dedup", "mixing", "bpe"]
    clean = by["toxicity"](spark, docs, SF).cache()
    assert clean.columns == docs.columns and 0.8 < clean.count() / docs.count() < 1
    assert not any(re.search("moron|clown|pathetic|disgusting", r.text) for r in clean.collect())
    y = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    count = lambda df, label: df.join(y, "doc_id").where(F.col("toxic") == label).count()
    assert count(clean, 1) < 0.7 * count(docs, 1) and count(clean, 0) > 0.95 * count(docs, 0)

    one = by["near-dedup"](spark, clean, SF).cache()
    want = groups([(r.doc_id, r.text) for r in clean.collect()], 5, 80)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in want.items() if i == c}

    cut = by["suffix-dedup"](spark, one, SF).cache()
    want = repeats([(r.doc_id, r.text.encode()) for r in one.collect()])
    assert cut.columns == docs.columns and cut.count() == one.count()
    exact = 0
    for r in cut.collect():
        n, gone, _, sha = want[r.doc_id]
        raw = r.text.encode()
        # A cut inside a character drops the rest of it, three bytes a side at most.
        assert n - gone - 6 * want[r.doc_id][2] <= len(raw) <= n - gone
        if len(raw) == n - gone:
            exact += 1
            assert hashlib.sha256(raw).hexdigest() == sha
    assert exact > 0.8 * len(want) and any(w[1] for w in want.values())
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    mix = by["mixing"](spark, cut, SF).cache()
    total = lambda df: df.agg(F.sum(F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")))).first()[0]
    assert mix.columns == docs.columns and abs(total(mix) - total(cut)) <= 20

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda t: (ids := codec.encode_ordinary(t), (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))[1]
    out = by["bpe"](spark, mix, SF).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted((r.doc_id, *digest(r.text)) for r in mix.collect())


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_on_odd_rows(spark, clash):
    """Nulls in every column, blank and long texts, repeated rows and clashing columns pass all stages without a crash."""
    own = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, own, "en", "a", None), (3, own, "en", "a", None), (None, "no id here", "en", None, 1), (4, "long word " * 30_000, "de", "b", 5), (5, own + " more", "en", "", 2)]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        if name != "bpe":
            assert kept.columns == docs.columns
            kept = kept.cache()
        ids = [r.doc_id for r in kept.collect()]
        if name == "toxicity":
            assert len(ids) == 7
        if name == "near-dedup":  # repeated rows of the smallest id stay, as does a row without an id
            assert sorted(ids, key=str) == [1, 2, 3, 3, 4, None]
        if name == "suffix-dedup":
            assert sorted(ids, key=str) == [1, 2, 3, 3, 4, None]
    assert set(ids) <= {3, 4, None} and 4 in ids  # texts without words are not mixed
