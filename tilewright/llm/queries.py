"""The queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table


def op2_quality_rules(spark, sf_dir):
    from . import quality_rules as q

    return q.apply_policy(q.ledger(table(spark, sf_dir, "documents")), 2).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_url_filter(spark, sf_dir):
    from . import url_filter as u

    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("outcome"))
    return u.judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark, sf_dir):
    from . import mixing

    return mixing.curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark, sf_dir):
    from . import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op2_quality_rules, op3_url_filter, op4_mixing, op9_warc)}

_WORD = r"'[^\x20\x09-\x0D]+'"

_OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(regexp_replace(body, '[^\p{{Lu}}]', '', 'g')) AS up, length(regexp_replace(body, '[^\p{{Ll}}]', '', 'g')) AS lo
  FROM d LEFT JOIN ln ON ln.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines) OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR (up > lo AND up >= 20)) AS kept FROM f
"""

_OP3 = """
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
o AS (SELECT doc_id AS page_id, avg(quality) AS outcome FROM labels GROUP BY doc_id),
h AS (SELECT host, coalesce(sum(outcome), 0) AS good, count(outcome) AS n, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix FROM p LEFT JOIN o USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM d GROUP BY ALL),
m AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 1) / (sum(n) + 2) ELSE 1.0 END AS mean FROM s),
g AS (SELECT 's' AS lvl, good, n FROM s UNION ALL SELECT 'd', good, n FROM d UNION ALL SELECT 'h', good, n FROM h),
v AS (SELECT lvl, mean, sum(n * power(good / n - mean, 2)) AS ss, sum(n) AS n, sum(n * n) AS nn, count(*) AS k FROM g, m WHERE n > 0 GROUP BY ALL),
b AS (SELECT lvl, mean, k, CASE WHEN n - nn / n > 0 THEN (ss - (k - 1) * mean * (1 - mean)) / (n - nn / n) ELSE 0 END AS between_ FROM v),
t AS (SELECT lvl, CASE WHEN k < 2 OR mean * (1 - mean) <= 0 OR between_ <= 0 THEN 1000.0 ELSE least(greatest(mean * (1 - mean) / between_ - 1, 2.0), 1000.0) END AS strength FROM b),
z AS (SELECT coalesce(max(strength) FILTER (lvl = 's'), 1000.0) AS ks, coalesce(max(strength) FILTER (lvl = 'd'), 1000.0) AS kd, coalesce(max(strength) FILTER (lvl = 'h'), 1000.0) AS kh, (SELECT mean FROM m) AS mean FROM t),
sm AS (SELECT suffix, (good + ks * mean) / (n + ks) AS q FROM s, z),
dm AS (SELECT domain, (good + kd * q) / (n + kd) AS q FROM d JOIN sm USING (suffix), z),
hm AS (SELECT host, n, kh, (good + kh * q) / (n + kh) AS q FROM h JOIN dm USING (domain), z),
r AS (SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN q + 1.645 * sqrt(q * (1 - q) / (n + kh + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM r JOIN hm USING (host)
"""

_OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(r - 1) % 3 + 1] AS DOUBLE) AS w, 3 * source_size AS lim FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER (ORDER BY lim / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY lim / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(CAST(lim AS DOUBLE), w * (SELECT arg_min(lev, lim / w) FROM l WHERE lev * w <= lim)) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS due, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN due // source_size * size + greatest(0, least(size, due % source_size - before_)) ELSE 0 END AS BIGINT) AS taken FROM c
"""
_OP4 = _OP4.replace("WITH RECURSIVE", "WITH")

_B32 = " || ".join(f"""(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(s1, {1 + 5 * i}, 5))::BIGINT >> (15 - 5 * j)) & 31 AS INTEGER) + 1, 1), '' ORDER BY j) FROM range(0, 4) AS q(j))""" for i in range(8))
_OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS s1, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM g
"""

ORACLE_SQL = {"op2_quality_rules": _OP2, "op3_url_filter": _OP3, "op4_mixing": _OP4, "op9_warc": _OP9}


def op5_quality_classifier(spark, sf_dir):
    from . import quality_qda as q

    docs, part = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = q.fit(docs, table(spark, sf_dir, "labels").where(part != 1))
    return q.score(docs, model).select("doc_id", (F.coalesce(part, F.lit(-1)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_bpe(spark, sf_dir):
    import public_tokenizers

    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES |= {f.__name__: f for f in (op5_quality_classifier, op7_bpe)}


def op1_near_dedup(spark, sf_dir):
    from . import near_dedup

    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=85)


def op6_top_k(spark, sf_dir):
    from . import knn

    vectors = table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_suffix_dedup(spark, sf_dir):
    from . import suffix_dedup

    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    from . import toxicity

    docs, part = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(part != 0))
    return toxicity.score(docs, model).select("doc_id", (F.coalesce(part, F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES |= {f.__name__: f for f in (op1_near_dedup, op6_top_k, op8_suffix_dedup, op10_toxicity)}

_OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v AS q, v AS c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""

ORACLE_SQL |= {"op6_top_k": _OP6}
