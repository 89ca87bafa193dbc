"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

statistics() reads a whole text once and gives a fixed vector of log and logit transformed counts.  fit() estimates one mean
and one covariance per class, shrinks each covariance towards the pooled one and the pooled diagonal, and caches the Cholesky
factor and log-determinant.  A score is the sigmoid of the difference of the two Gaussian log densities plus the log prior
odds, the Mahalanobis distances being one triangular product per class.

The model is fitted on at most SAMPLE labelled rows (smallest hashes first); every row is scored.  Defined cases: a null or
empty text has the statistics of no words and is scored like any other; null labels and rows that the caller leaves out teach
nothing; with fewer than two rows of a class every score is that class's absence, 0 or 1, and with no labels 0.5; repeated
rows are scored alike; columns that are not named are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most labelled rows that fit() learns from; they alone reach the driver, as vectors of fixed length.
SAMPLE = 20_000
#: Weights of the pooled covariance and of its diagonal in a class covariance, and the ridge on standardised features.
POOL, DIAGONAL, RIDGE = 0.1, 0.1, 1e-3
NAMES = ("words", "mean_word", "upper", "symbols", "pipes", "bangs", "digits", "other_punct", "distinct", "top_word", "adjacent", "dup_lines", "line_words", "stretch", "junk_line")
_SYMBOLS = b"#*$%&<>@^~=+\\/_{}[]"


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5 if whole >= part else 0.5)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of NAMES."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, counts = len(words), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(counts[[9, 10, 11, 12, 13, 32]].sum())
    upper = int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum())
    symbols = int(counts[list(_SYMBOLS)].sum())
    seen = Counter(words)
    top = max(seen.values(), default=0)
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x.split() for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    repeated = len(lines) - len({tuple(x) for x in lines})
    worst = max((_junk(x) for x in lines if len(x) >= 3), default=0.0)
    return [
        float(np.log1p(n)),
        float(np.log((chars + 1) / (n + 1))),
        _logit(upper, letters),
        float(np.log((symbols + 0.5) / (n + 1))),
        float(np.log((int(counts[124]) + 0.5) / (n + 1))),
        float(np.log((int(counts[33]) + 0.5) / (n + 1))),
        float(np.log((int(counts[48:58].sum()) + 0.5) / (n + 1))),
        float(np.log((int(counts[[44, 46, 58, 59, 63]].sum()) + 0.5) / (n + 1))),
        float(np.log((len(seen) + 1) / (n + 1))),
        float(np.log((top + 0.5) / (n + 1))),
        float(np.log((adjacent + 0.5) / (n + 1))),
        float(np.log((repeated + 0.5) / (len(lines) + 1))),
        float(np.log((n + 1) / (len(lines) + 1))),
        float(np.log1p(max(map(len, words), default=0))),
        worst,
    ]


def _junk(words: list[bytes]) -> float:
    """How far one line is from prose: the largest share of repeated, shouted or symbol-laden words, as a log."""
    n = len(words)
    repeats = max(Counter(words).values()) / n if n >= 8 else 0.0
    shouted = sum(w.isupper() for w in words) / n if n >= 4 else 0.0
    marked = sum(w[-1:] in b"!#*$%&|" for w in words) / n
    return float(np.log(max(repeats, shouted, marked, 0.02)))


class Model:
    """Standardisation, class means, cached Cholesky factors and log-determinants, and the log prior odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = None
        counts = [int((y == k).sum()) for k in (0, 1)]
        if min(counts) < 2:
            self.constant = 0.5 if counts[0] == counts[1] else float(counts[1] > counts[0])
            return
        self.shift, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = (x - self.shift) / self.scale
        groups = [z[y == k] for k in (0, 1)]
        own = [np.cov(g, rowvar=False, bias=True) for g in groups]
        pooled = sum(c * len(g) for c, g in zip(own, groups, strict=True)) / len(z)
        self.means, self.inverse, self.logdet = [g.mean(axis=0) for g in groups], [], []
        for cov in own:
            mixed = (1 - POOL - DIAGONAL) * cov + POOL * pooled + DIAGONAL * np.diag(np.diag(pooled)) + RIDGE * np.eye(len(cov))
            factor = np.linalg.cholesky(mixed)
            self.inverse.append(np.linalg.inv(factor))
            self.logdet.append(2 * float(np.log(np.diag(factor)).sum()))
        self.prior = float(np.log(counts[1] / counts[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.shift) / self.scale
        log_density = [-0.5 * ((((z - m) @ i.T) ** 2).sum(axis=1) + d) for m, i, d in zip(self.means, self.inverse, self.logdet, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0] + self.prior, -50, 50)))


def _vectors(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """labels: (key, label) rows to learn from.  A bounded sample of them is joined to the texts and turned into vectors there."""
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and k is not null")
    chosen = chosen.orderBy(F.xxhash64("k"), "k", "y").limit(sample)  # at most `sample` rows of two numbers
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = _vectors(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    given = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    got = given.join(F.broadcast(chosen), "k").select("y", "t").mapInArrow(run, schema).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(NAMES))
    return Model(x, np.array(got.column("y").to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_vectors(batch.column(1).to_pylist())))], names=schema.names)

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, schema)
