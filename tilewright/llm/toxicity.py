"""Toxicity: a support vector machine over a gapped-subsequence string kernel with Nystroem landmarks.

Texts are cut into sentences and sentences into words, each with the spaces around it; letters only, so that marks inside a
word are no part of it, and four or more single characters in a row are one word more ("i d i o t").  The kernel of two words
counts the subsequences of three characters that they share, spaces included, each occurrence weighted by DECAY to the length
it spans beyond three (at most SPAN characters), and is normalised; it is taken as it is, so it is positive definite.  Inserted
characters and gaps lower it but do not break it.  Words over LENGTH characters are overlapping windows.

Landmarks are words of toxic and of clean sentences in equal number, drawn without replacement with a chance that grows with the
share of the class's texts that hold them.  The Nystroem map of a word's kernel values with them gives its features, and a
linear SVM (squared hinge) judges them.  Training takes labelled sentences as bags of words: each toxic text has some word that
must be toxic, and every further word that the last SVM calls toxic is so too, chosen anew in each round, half of the time with
a foreign character inside; the words of clean texts are clean, each counted as often as clean texts hold it, and those further
inside the margin than INSIDE are sought among all of them in each round.  A sentence is as toxic as its worst word, and a
text's score is a logistic curve, fitted to the training texts, over the sum of the WORST largest margins of its sentences'
words; a word on the clean side adds nothing, so a long clean text does not outweigh one insult.

As features are linear in a word's subsequences, the SVM folds into one weight for each of them: a word's margin is the sum of
those weights over its subsequences, divided by their norm, and does not depend on the number of landmarks.

The model is fitted on at most SAMPLE labelled rows (smallest hashes first, whole texts, as word sets); every whole text is
scored.  Defined cases: null and empty texts have no sentence and score as the clean end of the curve; null
labels teach nothing; with one class, or no labels, every score is 0 (1 if all labels are toxic); repeated rows are scored
alike; a text or label row that stands there twice teaches twice.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trimmed

#: Most labelled rows that fit() learns from, most landmarks, and the words that a worker remembers.
SAMPLE, LANDMARKS, CACHE = 6_000, 600, 200_000
#: A word is drawn as a landmark with a weight that is this power of the number of texts that hold it.
POWER = 3
#: The SVM's cost for each text, the margin beyond which clean words are not sought, and the most frequent clean words that it starts from.
COST, INSIDE, START = 0.3, -0.5, 3000
#: So many of a text's largest margins make its score, and how far the curve balances the classes.
WORST, BALANCE = 2, 1.0
DECAY, SPAN, LENGTH, STEP = 0.7, 7, 16, 6
SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")


def _joined(words: list[str]) -> list[str]:
    """Words, followed by the join of each run of four or more single characters."""
    sizes = list(map(len, words))
    if sizes.count(1) < 4:
        return words
    single = [i for i, n in enumerate(sizes) if n == 1]
    out, lo = words[:], 0
    for hi in range(1, len(single) + 1):
        if hi == len(single) or single[hi] != single[hi - 1] + 1:
            if hi - lo >= 4:
                out.append("".join(words[single[lo] : single[hi - 1] + 1]))
            lo = hi
    return out


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, lower-cased; a text of any length is read whole."""
    return [w for s in SENTENCE.split(text.lower()) if (w := _joined(s.split()))]


def pieces(token: str) -> list[str]:
    """A token's letters and digits between two spaces, in overlapping windows if they are many; none if they are fewer than three."""
    word = token if token.isalnum() else "".join(filter(str.isalnum, token))
    if len(word) < 3:
        return []
    word = f" {word} "
    return [word] if len(word) <= LENGTH else [word[i : i + LENGTH] for i in range(0, len(word) - LENGTH + STEP, STEP)]


def inserted(piece: str) -> list[str]:
    """A piece with one character that no landmark has after each of its letters but the last."""
    return [piece[:i] + "\ufffd" + piece[i:] for i in range(2, len(piece) - 1)]


@functools.lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of n characters that span at most SPAN, and their weights."""
    t = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(t, np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] - 2)).astype(np.float32)


class Kernel:
    """Words (as pieces) as sparse vectors of subsequences over the characters of the landmarks; all others are one character."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.letters = landmarks, "".join(sorted(set("".join(landmarks))))
        self.base = len(self.letters) + 1

    @functools.cached_property
    def _alphabet(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int32)
        out[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
        return out

    def __getstate__(self):
        return {"landmarks": self.landmarks, "letters": self.letters, "base": self.base}

    def _parts(self, words: list[str]):
        """(places of some words of one length, their subsequences' codes, in the order of _triples(), and their norms)."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, own in by.items():
            at, weight = _triples(n)
            for lo in range(0, len(own), 2048):
                part = own[lo : lo + 2048]
                letters = self._alphabet[np.array([words[i] for i in part], f"<U{n}").view(np.uint32).reshape(len(part), n)]
                codes = (letters[:, at[:, 0]] * self.base + letters[:, at[:, 1]]) * self.base + letters[:, at[:, 2]]
                # Equal subsequences of one word add up before they are squared.
                order = np.argsort(codes, axis=1)
                c = np.take_along_axis(codes, order, axis=1)
                new = np.ones(c.shape, bool)
                new[:, 1:] = c[:, 1:] != c[:, :-1]
                sums = np.add.reduceat(weight[order].ravel(), np.flatnonzero(new.ravel()))
                norm = np.sqrt(np.bincount(np.nonzero(new)[0], sums * sums, minlength=len(part)))
                yield np.array(part), codes, weight, norm

    def values(self, words: list[str], others: list[str]) -> np.ndarray:
        """The kernel of every word with every other, through the others' subsequences."""
        found: dict[int, int] = {}
        rows, columns, data = [], [], []
        for part, codes, weight, norm in self._parts(others):
            for i, row, n in zip(part.tolist(), codes.tolist(), norm.tolist(), strict=True):
                rows.append(np.array([found.setdefault(c, len(found)) for c in row], np.int64))
                columns.append(np.full(len(row), i))
                data.append(weight / n)
        table = np.zeros((len(found) + 1, len(others)), np.float32)
        np.add.at(table, (np.concatenate(rows), np.concatenate(columns)), np.concatenate(data))
        place = np.full((self.base + 1) ** 3, len(found), np.int32)
        place[list(found)] = list(found.values())
        out = np.empty((len(words), len(others)), np.float32)
        for part, codes, weight, norm in self._parts(words):
            for lo in range(0, len(part), 32):
                some = slice(lo, lo + 32)
                out[part[some]] = np.einsum("t,wtm->wm", weight, table[place[codes[some]]], optimize=True) / norm[some, None]
        return out

    def folded(self, alpha: np.ndarray) -> np.ndarray:
        """One weight for each subsequence, so that margins() equals the kernel values with the landmarks times alpha."""
        out = np.zeros((self.base + 1) ** 3)
        for part, codes, weight, norm in self._parts(self.landmarks):
            np.add.at(out, codes, weight * (alpha[part] / norm)[:, None])
        return out.astype(np.float32)

    def margins(self, words: list[str], folded: np.ndarray, bias: float) -> np.ndarray:
        out = np.empty(len(words))
        for part, codes, weight, norm in self._parts(words):
            out[part] = (folded[codes] @ weight) / norm
        return out + bias


class Model:
    def __init__(self, kernel: Kernel, folded: np.ndarray, bias: float, curve: np.ndarray):
        self.kernel, self.folded, self.bias, self.curve = kernel, folded, bias, curve
        self.forget()

    def forget(self) -> None:
        """Drop what a worker remembers of the tokens it has seen."""
        self.near: dict[str, float] = {}
        self.known: set[str] = set()

    def __getstate__(self):
        return self.__dict__ | {"near": {}, "known": set()}

    def learn(self, tokens: set[str]) -> None:
        """Remember the margin of every token that is above 0."""
        new = tokens - self.known
        if len(self.known) + len(new) > CACHE:
            self.forget()
            new = tokens
        own = [(t, p) for t in new for p in pieces(t)]
        margins = self.kernel.margins([p for _, p in own], self.folded, self.bias)
        for i in np.flatnonzero(margins > 0).tolist():
            t = own[i][0]
            self.near[t] = max(float(margins[i]), self.near.get(t, 0.0))
        self.known |= new

    def scores(self, texts: list[str]) -> list[float]:
        bags = [set(_joined(t.lower().split())) for t in texts]
        if not (words := set().union(*bags)) <= self.known:
            self.learn(words)
        z = np.array([worst(self.near[w] for w in bag if w in self.near) for bag in bags])
        return (1 / (1 + np.exp(-np.clip(z * self.curve[0] + self.curve[1], -50, 50)))).tolist()


def worst(margins) -> float:
    """The sum of the WORST largest margins above 0."""
    return sum(sorted(margins, reverse=True)[:WORST])


class Constant:
    def __init__(self, value: float):
        self.value = value

    def forget(self) -> None:
        pass

    def scores(self, texts: list[str]) -> list[float]:
        return [self.value] * len(texts)


def _held(words: int, bags: list[np.ndarray]) -> np.ndarray:
    """How many bags hold each word."""
    return np.bincount(np.concatenate([*bags, np.empty(0, np.int64)]).astype(np.int64), minlength=words)


def choose_landmarks(words: list[str], bad: np.ndarray, good: np.ndarray, most: int) -> list[str]:
    """Words of both classes' texts, drawn without replacement, by the number of the class's texts that hold them."""
    draw = np.array([(zlib.crc32(w.encode()) + 0.5) / 2**32 for w in words])
    chosen: dict[str, None] = {}
    for held in (bad, good):
        # The largest u ** (1 / weight) are such a draw.
        rank = np.full(len(words), -np.inf)
        rank[held > 0] = np.log(draw[held > 0]) / held[held > 0].astype(float) ** POWER
        new = [words[i] for i in np.argsort(-rank, kind="stable")[: int((held > 0).sum())] if words[i] not in chosen]
        chosen |= dict.fromkeys(new[: most // 2])
    return list(chosen)



def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """Weights, the bias last, of a linear SVM with squared hinge loss, by Newton steps on the active set from w; y in -1, 1."""
    ridge = np.append(np.ones(x.shape[1]), 1e-3)
    w = np.zeros(x.shape[1] + 1) if w is None else w
    at = lambda v: x @ v[:-1].astype(x.dtype) + v[-1]
    loss = lambda v: 0.5 * v @ (ridge * v) + (weight * np.maximum(0, 1 - y * at(v)) ** 2).sum()
    for _ in range(steps):
        f = at(w)
        on = np.flatnonzero(y * f < 1)
        grad, curve = ridge * w, np.diag(ridge)
        for lo in range(0, len(on), 2048):  # a block of rows at a time, to bound memory
            i = on[lo : lo + 2048]
            z = np.hstack([x[i], np.ones((len(i), 1), x.dtype)])
            a = z * weight[i, None].astype(x.dtype)
            grad -= 2 * (a.T @ (y[i] - f[i]).astype(x.dtype))
            curve += 2 * (a.T @ z)
        if np.abs(grad).max() < 1e-3:
            break
        move = np.linalg.solve(curve, grad)
        t, now = 1.0, loss(w)
        while t > 1e-4 and loss(w - t * move) > now:
            t /= 2
        w = w - t * move
    return w


def train(docs, y: np.ndarray, most: int = LANDMARKS, rounds: int = 5):
    """A Model from texts, given one by one as sentences of words, and their labels."""
    if len(set(y.tolist())) < 2:
        return Constant(float(len(y) > 0 and y[0] == 1))
    numbers: dict[str, int] = {}
    bags = [np.unique(np.array([numbers.setdefault(p, len(numbers)) for w in {w for s in d for w in s} for p in pieces(w)], np.int32)) for d in docs]
    words = list(numbers)
    toxic = [b for b, label in zip(bags, y, strict=True) if label == 1 and len(b)]
    if not toxic:
        return Constant(0.0)
    bad, good = _held(len(words), toxic), _held(len(words), [b for b, label in zip(bags, y, strict=True) if label == 0])
    kernel = Kernel(choose_landmarks(words, bad, good, most))
    values, vectors = np.linalg.eigh(kernel.values(kernel.landmarks, kernel.landmarks).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    # Start from the toxic texts' words that such texts hold most often for each time that clean ones do, and frequent clean words.
    share = bad / (good + 1)
    telling = lambda b, best: b[share[b] >= best / 2] if best > 1 else b[[np.argmax(share[b])]]
    positive = np.unique(np.concatenate([telling(b, share[b].max()) for b in toxic]))
    mined = np.argsort(-good, kind="stable")[: min(START, int((good > 0).sum()))]
    root32 = root.astype(np.float32)
    pool, x, w = np.empty(0, np.int64), np.empty((0, len(kernel.landmarks)), np.float32), None
    for _ in range(rounds):
        rows = np.concatenate([positive, mined])
        new = np.setdiff1d(rows, pool)
        pool, x = np.concatenate([pool, new]), np.vstack([x, kernel.values([words[i] for i in new], kernel.landmarks) @ root32])
        place = np.empty(len(words), np.int64)
        place[pool] = np.arange(len(pool))
        # A toxic word counts half itself and half with one foreign character inside, wherever that is.
        spread = [inserted(words[i]) for i in positive]
        foreign = kernel.values([v for some in spread for v in some], kernel.landmarks) @ root32
        times = np.array([len(some) for some in spread])
        worth = bad[positive] / len(toxic) / 2
        weight = COST * len(bags) * np.concatenate([worth, good[mined] / max(1, len(bags) - len(toxic)), np.repeat(worth / np.maximum(times, 1), times)])
        w = svm(np.vstack([x[place[rows]], foreign]), np.concatenate([np.ones(len(positive)), -np.ones(len(mined)), np.ones(len(foreign))]), weight, w)
        folded = kernel.folded(root @ w[:-1])
        margin = kernel.margins(words, folded, w[-1])
        then = np.unique(np.concatenate([[b[np.argmax(margin[b])] for b in toxic], np.flatnonzero((bad > good) & (margin > 0))]))
        inside = np.setdiff1d(np.flatnonzero((good > 0) & (margin > INSIDE)), mined)
        if np.array_equal(then, positive) and not len(inside):
            break
        positive, mined = then, np.union1d(mined, inside)
    return Model(kernel, folded, float(w[-1]), logistic(np.array([worst(margin[b][margin[b] > 0].tolist()) for b in bags]), y))


def logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope (0 or more) and offset of a logistic curve by Newton steps, with the labels smoothed as Platt does.

    A toxic text counts as the classes' ratio to the power of BALANCE; 1 would balance them, 0 leave them as they are."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, (n0 / n1) ** BALANCE, 1.0)
    z, v, ridge = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0]), np.diag([1e-2, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + ridge, z.T @ (weight * (p - target)) + ridge @ v)
        v = v - np.clip(step, -2, 2)
        v[0] = max(v[0], 0.0)
    return v


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE):
    """labels: (key, label) rows to learn from; a bounded sample of them is joined to the texts, which arrive as sentences."""
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and k is not null")
    chosen = chosen.orderBy(F.xxhash64("k"), "k", "y").limit(sample)  # at most `sample` rows of two numbers
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("s", T.StringType())])

    @trimmed
    def run(batches):
        for batch in batches:
            # A sentence arrives as its distinct words; clean repetitions cost nothing.
            cut = ["\n".join(dict.fromkeys(" ".join(dict.fromkeys(s)) for s in sentences(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], names=["y", "s"])

    given = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    got = given.join(F.broadcast(chosen), "k").select("y", "t").mapInArrow(run, schema).toArrow()
    y = np.array(got.column("y").to_pylist(), np.int64)
    return train(([s.split(" ") for s in t.as_py().split("\n") if s] for t in got.column("s")), y)


def _groups(texts: list[str], chars: int = 2_000_000):
    """Texts that are scored together, so that new words are compared in large batches."""
    lo = size = 0
    for hi, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[lo : hi + 1]
            lo, size = hi + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the alphabet of LANDMARKS words

    @trimmed
    def run(batches):
        own = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [s for g in _groups(texts) for s in own.scores(g)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=schema.names)
        own.forget()  # workers live on

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, schema)


def clean(docs: DataFrame, model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns and without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text)

    @trimmed
    def run(batches):
        own = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = np.array([s for g in _groups(texts) for s in own.scores(g)])
            kept = batch.filter(pa.array(found < threshold, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=names)
        own.forget()

    return docs.mapInArrow(run, docs.schema)
