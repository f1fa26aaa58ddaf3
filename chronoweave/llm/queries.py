"""Registered queries of the numbered operators: (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import (filter_audit, fit_packing, host_rules, importance, inner_products, mixing, near_dup, repeated_text, suffix_tree,
                             token_count, token_matrix, toxicity, url_filter)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
MIX_SEED = 17


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER, size=1024, end_id=2)


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"), depth=3)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_min_max_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=5, part=75, whole=100)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality(_table(spark, sf_dir, "documents")).drop("host_rate")


def op8_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix.packed(_table(spark, sf_dir, "documents"), TOKENIZER, size=1024)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), TOKENIZER, limit=512)


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), power=0.5, seed=MIX_SEED)


def op11_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text.remove_repeats(_table(spark, sf_dir, "documents"), window=200).drop("cuts")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), longest=1,
                               buckets=10_000, min_words=20, percent=10, seed=2024)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_suffix_tree_scores": op3_suffix_tree_scores,
    "op4_url_filter": op4_url_filter,
    "op5_min_max_near_duplicates": op5_min_max_near_duplicates,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_host_rules": op7_host_rules,
    "op8_token_matrices": op8_token_matrices,
    "op9_token_counts": op9_token_counts,
    "op10_poisson_mixing": op10_poisson_mixing,
    "op11_repeated_strings": op11_repeated_strings,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_filter_audit": op13_filter_audit,
}

_OP4 = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_OP6 = """
WITH fine AS (
  SELECT CAST(vec_id AS BIGINT) AS id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.id % 50 = 0 AND q.id <> c.id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

_OP7 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM d),
win AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM w, unnest(range(1, len(words) - 1)) AS u(i) WHERE len(words) >= 3),
twin AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twin, unnest([0, 1, 2]) AS o(k) GROUP BY r),
m AS (
  SELECT d.doc_id, d.host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (
  SELECT host, count(*) AS n, CAST(sum(CAST(base_failed AS INTEGER)) AS DOUBLE) AS bad
  FROM f WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT avg(bad / n) AS mean, coalesce(var_samp(bad / n), 0) AS var, avg(n) AS size FROM h),
s AS (SELECT mean, CASE WHEN var > 0 AND var < mean * (1 - mean) THEN mean * (1 - mean) / var - 1
                        ELSE size END AS strength FROM p),
v AS (SELECT host, (bad + strength * mean) / (n + strength) > 0.5 AS host_failed FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM f LEFT JOIN v USING (host)
"""

_OP10 = """
WITH RECURSIVE counts AS (
  SELECT coalesce('=' || source, 'null') AS s, count(*) AS n FROM documents GROUP BY 1),
rates AS (
  SELECT s, CAST((SELECT sum(n) FROM counts) AS DOUBLE) * sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) / n AS rate
  FROM counts),
steps AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cum FROM rates
  UNION ALL
  SELECT s, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM steps WHERE k < 3 * rate + 60),
draws AS (
  SELECT doc_id, text, lang, source, n_chars, coalesce('=' || source, 'null') AS s,
         CAST(CAST('0x' || substr(md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), ''),
              md5(coalesce(text, '')), twin)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, '')) > 1
                       THEN concat_ws(':', lang, source, n_chars,
                            row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars)) END AS twin
        FROM documents)),
times AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.u,
         (SELECT count(*) FROM steps t WHERE t.s = d.s AND t.cum <= d.u) AS n
  FROM draws d)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy
FROM times, unnest(range(1, n + 1)) AS e(copy)
"""

_OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT r, doc_id, x, length(x) // 2 AS n FROM d),
w AS (SELECT r, i, hash(substr(x, CAST(2 * i + 1 AS BIGINT), 400)) AS h
      FROM n, unnest(range(0, n - 199)) AS u(i) WHERE n >= 200),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w SEMI JOIN twice USING (h)),
run AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY r, k),
keep AS (
  SELECT r, k, b AS f, lead(a) OVER (PARTITION BY r ORDER BY a) AS t FROM span
  UNION ALL SELECT r, 0, 0, min(a) FROM span GROUP BY r),
rest AS (
  SELECT r, string_agg(substr(x, CAST(2 * f + 1 AS BIGINT), CAST(2 * (coalesce(t, n) - f) AS BIGINT)), '' ORDER BY f) AS x
  FROM keep JOIN n USING (r) GROUP BY r),
gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest.x, n.x))) AS kept_sha256
FROM n LEFT JOIN gone USING (r) LEFT JOIN rest USING (r)
"""

_OP12 = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) AS c
    FROM range(256) AS u(i))),
text_words AS (
  SELECT 's' AS side, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), text FROM benchmark),
words AS (
  SELECT side, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM text_words),
kinds AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM words),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(
    list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256), 4294967295)) % 10000 AS b
  FROM kinds, crc),
uses AS (SELECT side, r, b, count(*) AS c FROM words JOIN hashed USING (w) GROUP BY side, r, b),
totals AS (SELECT b, coalesce(sum(c) FILTER (side = 's'), 0) AS s, coalesce(sum(c) FILTER (side = 't'), 0) AS t FROM uses GROUP BY b),
alls AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM totals),
gain AS (
  SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM totals, alls),
weights AS (SELECT r, sum(c) AS n, sum(c * g) AS weight FROM uses JOIN gain USING (b) WHERE side = 's' GROUP BY r),
rows AS (
  SELECT row_number() OVER () AS r, doc_id,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
scored AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM rows LEFT JOIN weights USING (r)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS p,
         count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= k THEN CAST(p AS BIGINT) END AS rank FROM placed
"""

_OP13 = r"""
WITH firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (
  SELECT part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(d.doc_id > first, false) THEN 'E' ELSE '' END AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN firsts USING (t) LEFT JOIN flags ON flags.doc_id = d.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS f, filter_order[1:s - 1] AS past
          FROM orders, range(1, 6) AS u(s)),
acts AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails,
         len(list_intersect(string_split(fails, ''), string_split(past, ''))) > 0 AND fails <> '' AND past <> '' AS went,
         contains(fails, f) AS hit FROM cells, steps),
counts AS (
  SELECT part, filter_order, step, f,
    CAST(coalesce(sum(n) FILTER (NOT went AND NOT hit), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT went AND hit), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (went AND hit), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (NOT went AND hit), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (NOT went AND hit), 0) AS BIGINT) AS toxic_lost
  FROM acts GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counts
"""

ORACLES = {"op4_url_filter": _OP4, "op6_exact_top_k": _OP6, "op7_host_rules": _OP7, "op10_poisson_mixing": _OP10,
           "op11_repeated_strings": _OP11, "op12_importance_resampling": _OP12, "op13_filter_audit": _OP13}
