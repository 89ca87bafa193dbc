from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    def make(texts, start=0, extra=""):
        rows = [(i + start, t, "en", f"src{i % 3}" if i % 5 else None, None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture()
def clash():
    """Columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({c: F.lit(f"x-{c}") for c in ("id", "key", "n", "keys", "comp", "rep", "h", "size", "t", "k", "y", "words", "blob", "chunk", "part", "position", "score")})
