"""From raw documents to tokens in five stages: toxicity, near-dedup, repeated passages, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of docs.
No SQL can express the stages, so there is no ORACLE_SQL; tests hold them against brute force.

Defined cases: a null or blank text is never toxic, is nobody's copy, loses nothing, is not mixed (the mix has words only) and so
is not encoded; a row without an id stays and removes nothing elsewhere; rows that repeat an id are judged alike, so the
repeats of a kept document stay; a null source is a source of its own; no documents give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright import ship
from tilewright.llm import bpe, mixing, near_dedup, suffix_dedup, toxicity
from tilewright.llm.common import table, written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.  Rows held out from op10's training are held out here too."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(part != 0))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return near_dedup.deduplicated(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside a 50-byte string that a document with a smaller id holds go; n_chars follows the text."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes they decode to."""
    ship(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("suffix-dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; what a stage returns is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
