"""What the operators of this subpackage share: words, table paths and tables that cut lineage."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..tables import dropped, new_path, written

__all__ = ["LOWER", "SPACES", "UPPER", "ascii_lower", "dropped", "n_words_of", "new_path", "table", "trimmed", "words_of", "written"]

#: One or more of the six ASCII white-space characters; every other character belongs to a word.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """The number of words as a long: places where a word begins, without building the array."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def handed_back() -> None:
    """Give the system what this process has freed: Arrow's pool and the C heap, where large arrays get maps of their own."""
    pa.default_memory_pool().release_unused()
    c = ctypes.CDLL(None)
    if hasattr(c, "malloc_trim"):
        c.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows with the arrays that were freed
        c.malloc_trim(0)


def trimmed(run):
    """A function over batches whose Python worker is small before and after it: workers live on, and their memory counts beside
    that of the tasks that follow in other workers."""

    @functools.wraps(run)
    def whole(batches):
        handed_back()
        try:
            yield from run(batches)
        finally:
            handed_back()

    return whole
