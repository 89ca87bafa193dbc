"""Quality rules as a bitmask ledger, in DataFrame functions only.

ledger() evaluates every rule once per row and stores the failure bits beside the measurements.  A policy is a versioned
mask over those bits; apply_policy() and ablation() read the ledger only, with bitwise functions, and never the text again.

Defined cases: a null or empty text has no words and fails `few_words`; ties and repeated rows are judged row by row; an
empty table gives an empty ledger; columns beyond the key and the text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: name -> failing condition over the ledger's measurements.  The position in this dictionary is the rule's bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 25 * n_words",
    "shouting": "n_upper > n_lower and n_upper >= 20",
    "no_letters": "10 * (n_upper + n_lower) < 4 * word_chars and word_chars >= 100",
}
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules whose failure rejects a row.
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "duplicate_lines", "short_mean_word", "long_mean_word", "shouting"),
    3: tuple(RULES),
}


def mask_of(names) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in set(names))


def _bound(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(array: Column, f) -> Column:
    n = F.size(array)
    return F.zip_with(F.slice(array, 1, n - 1), F.slice(array, 2, n - 1), f)


def _repeated(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort (hash, position), keep equal neighbours, add up the cover."""
    nothing = F.array().cast("array<int>")
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = _bound(keyed, lambda s: F.sort_array(F.array_distinct(F.flatten(_pairs(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(nothing))))))
    return _bound(twice, lambda p: F.aggregate(_pairs(p, lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(WINDOW).cast("long"), lambda total, x: total + x))


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, the measurements, and `failed`, whose bit i is set if rule i fails."""
    given = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    lines = F.filter(F.split("body", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    split = given.select("key", "body", words_of(F.col("body")).alias("words"), lines.alias("lines"))
    n = F.size("words")
    at = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashed = split.select("key", "body", "lines", n.cast("long").alias("n_words"), F.transform(at, lambda i: F.xxhash64(F.slice("words", i, WINDOW))).alias("hashes"))
    count = lambda c: F.length(c).cast("long")
    without = lambda chars: F.translate(F.col("body"), chars, "")
    measured = hashed.select(
        "key",
        "n_words",
        count(without(" \t\n\x0b\x0c\r")).alias("word_chars"),
        (count(F.col("body")) - count(without(SYMBOLS))).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0).cast("long")).otherwise(_repeated(F.col("hashes"))).alias("n_repeat_words"),
        count(F.regexp_replace("body", "\\P{Lu}+", "")).alias("n_upper"),
        count(F.regexp_replace("body", "\\P{Ll}+", "")).alias("n_lower"),
    )
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed).withColumnRenamed("key", key)


def apply_policy(led: DataFrame, version: int) -> DataFrame:
    """The ledger with `base_failed` and `kept` under the policy of that version."""
    hit = lambda names: F.col("failed").bitwiseAND(F.lit(mask_of(names))) != 0
    return led.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit(POLICIES[version]))


def ablation(led: DataFrame, version: int) -> DataFrame:
    """One row per rule of the policy: rows it fails, and rows that would return if it alone were dropped."""
    mask = mask_of(POLICIES[version])
    over = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [F.coalesce(F.sum(F.when(F.bit_get("failed", F.lit(i)) == 1, 1)), F.lit(0)).alias(f"f{i}") for i in range(len(RULES))]
    sums += [F.coalesce(F.sum(F.when(over == (1 << i), 1)), F.lit(0)).alias(f"a{i}") for i in range(len(RULES))]
    rows = [F.struct(F.lit(r).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"a{i}").alias("n_only")) for i, r in enumerate(RULES) if mask >> i & 1]
    return led.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
