from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import quality_qda, queries, toxicity

SF = "/root/testdata/sf0.1"


def accuracy(spark, rows, label):
    y = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    held = rows.where("held_out").join(y, "doc_id").collect()
    assert len(held) > 300
    return np.mean([r.predicted == r[label] for r in held]), np.mean([r.score > 0.5 for r in held if r[label] == 1])


def test_quality_on_held_out_rows(spark):
    out = queries.op5_quality_classifier(spark, SF).cache()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert accuracy(spark, out, "quality")[0] > 0.97


def test_toxicity_on_held_out_rows(spark):
    out = queries.op10_toxicity(spark, SF).cache()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    right, caught = accuracy(spark, out, "toxic")
    assert right > 0.97 and caught > 0.85


def test_toxicity_in_languages_with_few_labelled_rows(spark):
    y = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = queries.op10_toxicity(spark, SF).where("held_out").join(y, "doc_id").join(docs, "doc_id").where("toxic is not null").collect()
    caught = lambda some: np.mean([r.predicted for r in held if r.toxic == 1 and some(r)])
    # Not English: inflections of stems that clean texts hold as well.
    assert caught(lambda r: r.lang != "en") > 0.85 and caught(lambda r: True) > 0.85
    assert np.mean([r.predicted for r in held if r.toxic == 0]) < 0.03 and np.mean([r.predicted == r.toxic for r in held]) > 0.97
    labels = y.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    m = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    # One insult is enough, though most toxic texts hold several.
    for word in ("trash", "pathetic", "idiot", "loser", "disgusting", "moron", "worthless", "stupid", "scum", "clown"):
        assert m.scores([f"Some lines at rest. You {word} there."])[0] > 0.5, word


def toy(n=400, seed=4):
    rng, texts, y = random.Random(seed), [], []
    common = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    for i in range(n):
        s = [" ".join(rng.choice(common) for _ in range(8)) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            s[rng.randrange(len(s))] += " " + rng.choice(["blockhead", "dumbwit"])
        texts.append(". ".join(s) + ".")
        y.append(int(i % 4 == 0))
    return texts, np.array(y)


def test_gaps_and_insertions_are_still_caught():
    texts, y = toy()
    m = toxicity.train((toxicity.sentences(t) for t in texts), y)
    for word in ("blockhead", "Blockhead!", "b.l.o.c.k.h.e.a.d", "block-head", "blo*ckhead", "b l o c k h e a d", "blockheads", "blxockhead"):
        assert m.scores([f"Some lines at rest. You {word} there."])[0] > 0.5, word
    assert max(m.scores(["Nothing here at all.", "", "a"])) < 0.5


def test_models_with_too_little_to_learn(spark, docs, clash):
    df = clash(docs(["", None, "bad " * 50_000, "fine words"]))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(0, 1, 1), (1, None, None), (2, 1, 1), (2, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels, quality, toxic in ((none, 0.5, 0.0), (one, 1.0, 1.0)):
        q = quality_qda.score(df, quality_qda.fit(df, labels))
        t = toxicity.score(df, toxicity.fit(df, labels))
        assert {r.score for r in q.collect()} == {quality} and {r.score for r in t.collect()} == {toxic}
    assert toxicity.score(df.limit(0), toxicity.Constant(0.0)).count() == 0
    assert toxicity.clean(df, toxicity.Constant(0.0)).columns == df.columns


def test_statistics_of_odd_texts():
    for t in ("", " ", "\n", "word", "A" * 10_000, "\ud800x", "a\nb\na\nb"):
        assert np.isfinite(quality_qda.statistics(t)).all()


def test_qda_separates_by_covariance():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (500, 3)), rng.normal(0, 4, (500, 3))])
    y = np.repeat([0, 1], 500)
    s = quality_qda.Model(x, y).score(x)
    assert ((s >= 0.5) == (y == 1)).mean() > 0.8


def test_scores_of_the_qda_equal_brute_force():
    """Log-densities from determinants and inverses of the shrunken covariances, row by row."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (80, 4)) @ rng.normal(0, 1, (4, 4)), rng.normal(1, 2, (30, 4))])
    y = np.repeat([0, 1], [80, 30])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    groups = [z[y == k] for k in (0, 1)]
    covariances = [(g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) / len(g) for g in groups]
    pooled = sum(c * len(g) for c, g in zip(covariances, groups, strict=True)) / len(z)
    q, want = quality_qda, []
    for row in z:
        d = []
        for g, c in zip(groups, covariances, strict=True):
            s = (1 - q.POOL - q.DIAGONAL) * c + q.POOL * pooled + q.DIAGONAL * np.diag(np.diag(pooled)) + q.RIDGE * np.eye(4)
            v = row - g.mean(axis=0)
            d.append(-0.5 * (v @ np.linalg.inv(s) @ v + np.log(np.linalg.det(s))) + np.log(len(g) / len(z)))
        want.append(np.exp(d[1]) / (np.exp(d[0]) + np.exp(d[1])))
    assert np.allclose(q.Model(x, y).score(x), want, atol=1e-9)


def subsequences(word):
    """Every subsequence of three characters with its weight, occurrence by occurrence."""
    out = {}
    for i, j, k in combinations(range(len(word)), 3):
        if k - i < toxicity.SPAN:
            c = word[i] + word[j] + word[k]
            out[c] = out.get(c, 0.0) + toxicity.DECAY ** (k - i - 2)
    return out


def test_kernel_equals_brute_force():
    rng = random.Random(8)
    words = [f" {''.join(rng.choice('abcé漢') for _ in range(rng.randint(3, 13)))} " for _ in range(40)] + ["abcabcabcabcabca", " aaa "]
    vectors = [subsequences(w) for w in words]
    dot = lambda u, v: sum(x * v.get(c, 0.0) for c, x in u.items())
    want = np.array([[dot(u, v) / np.sqrt(dot(u, u) * dot(v, v)) for v in vectors] for u in vectors])
    kernel = toxicity.Kernel(words)
    got = kernel.values(words, words)
    assert np.allclose(got, want, atol=1e-5)
    assert np.linalg.eigvalsh(got.astype(float)).min() > -1e-4
    alpha = np.array([rng.uniform(-1, 1) for _ in words])
    assert np.allclose(kernel.margins(words, kernel.folded(alpha), 0.25), want @ alpha + 0.25, atol=1e-4)


def test_pieces_of_words():
    assert toxicity.pieces("ab.c!") == [" abc "] and toxicity.pieces("a-b") == [] == toxicity.pieces("")
    long = "abcdefghijklmnopqrstuvwxyz" * 2
    assert all(len(p) <= toxicity.LENGTH for p in toxicity.pieces(long))
    assert {c for p in toxicity.pieces(long) for c in subsequences(p)} >= set(subsequences(f" {long[:10]}"))


def test_landmarks_come_from_both_classes():
    words = [f"w{i}" for i in range(100)]
    bad, good = np.array([5] * 50 + [0] * 50), np.array([0] * 50 + [5] * 50)
    chosen = toxicity.choose_landmarks(words, bad, good, 40)
    assert sum(int(w[1:]) < 50 for w in chosen) == 20 == sum(int(w[1:]) >= 50 for w in chosen)
    assert len(toxicity.choose_landmarks(words, bad, good, 1000)) == 100


def test_hashes_choose_the_same_sample(spark):
    assert spark.range(5).orderBy(F.xxhash64("id")).limit(2).count() == 2
