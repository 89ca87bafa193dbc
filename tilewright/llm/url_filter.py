"""URL filtering by explicit rules and by empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted per host and shrunk level by level through beta-binomial priors: the
suffix towards the whole table, the registered domain towards its suffix, the host towards its domain.  Prior strengths come
from the spread between groups (method of moments).  A page is blocked when the upper posterior bound of its host's good
rate is below the threshold, so little evidence never blocks.  Hosts without labels inherit their parent's posterior.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is judged by the table's prior;
null outcomes are unlabelled; repeated rows are judged alike; with no labels at all every unruled page is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host/path): the longest rule that fits wins; at equal length the later host, and block before allow.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
THRESHOLD = 0.5
BOUND_Z = 1.645
#: Prior strengths stay inside this range, in pseudo-pages.
STRENGTHS = (2.0, 1000.0)
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(found, URL, 1)), F.regexp_extract(found, URL, 2)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), both null where none fits.  rules is a short list that becomes one expression."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1].partition("/")[0], r[0] == "block")):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(groups: DataFrame, mean: float) -> float:
    """Pseudo-pages of the prior above these (good, n) groups: mean*(1-mean)/between-variance - 1, kept inside STRENGTHS."""
    spread = mean * (1 - mean)
    # Between-group variance: weighted squares minus what sampling alone would give.
    row = groups.where("n > 0").agg(F.sum(F.col("n") * (F.col("good") / F.col("n") - F.lit(mean)) ** 2).alias("ss"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k")).first()
    if not row["k"] or row["k"] < 2 or spread <= 0:
        return STRENGTHS[1]
    scale = row["n"] - row["nn"] / row["n"]
    between = (row["ss"] - (row["k"] - 1) * spread) / scale if scale > 0 else 0.0
    return STRENGTHS[1] if between <= 0 else min(max(spread / between - 1, STRENGTHS[0]), STRENGTHS[1])


def reputation(outcomes: DataFrame, z: float = BOUND_Z) -> tuple[DataFrame, float]:
    """(host, good, n, mean, bound) from (host, outcome), and the bound of hosts unknown at every level.

    Each level is aggregated from the level below, so the pages are shuffled once, by host; only four sums reach the driver."""
    host = outcomes.groupBy("host").agg(F.coalesce(F.sum("outcome"), F.lit(0)).alias("good"), F.count("outcome").alias("n"))
    host = host.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
    domain = host.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suf = domain.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    all_ = suf.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    mean = (all_["good"] + 1) / (all_["n"] + 2) if all_["n"] else 1.0
    ks, kd, kh = (_strength(x, mean) for x in (suf, domain, host))
    shrunk = lambda prior, k: (F.col("good") + F.lit(k) * prior) / (F.col("n") + F.lit(k))
    suf = suf.select("suffix", shrunk(F.lit(mean), ks).alias("suffix_mean"))
    domain = domain.join(suf, "suffix").select("domain", shrunk(F.col("suffix_mean"), kd).alias("domain_mean"))
    host = host.join(domain, "domain").withColumn("mean", shrunk(F.col("domain_mean"), kh))
    bound = F.col("mean") + F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(kh + 1)))
    return host.select("host", "good", "n", "mean", bound.alias("bound")), mean


def judge(pages: DataFrame, outcomes: DataFrame | None = None, key: str = "page_id", url: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, host, path, rule, verdict, bound) per page.  outcomes: (key, outcome) with the page's label."""
    host, path = parts(F.col(url))
    given = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    if outcomes is None:
        known = given.withColumn("outcome", F.lit(None).cast("int"))
    else:
        # Outcomes are first summed by page, so a page with several labels stays one row.
        by = outcomes.select(F.col(key).alias("key"), F.col("outcome").cast("double").alias("outcome")).groupBy("key").agg(F.avg("outcome").alias("outcome"))
        known = given.join(by, "key", "left")
    rep, mean = reputation(known.select("host", "outcome"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    scored = given.join(rep.select("host", "bound"), "host", "left")
    reputed = F.when(F.coalesce("bound", F.lit(mean)) < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(said, reputed).alias("verdict"), "bound")
