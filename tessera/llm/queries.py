"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (bpe, centroids, exact_dedup, license_scan, line_dedup, minhash, packing, prefix_trie, quality, simhash,
                         token_counts, toxicity, url_filter)
from tessera.llm.common import tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@_query(r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_code,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents),
ranked AS (
  SELECT doc_id, content, count(*) OVER (PARTITION BY content) AS group_size,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY n_code DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM ranked
""")
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


@_query(r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rule, h, p, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                            ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fit AS (
  SELECT p.*, r.rule, r.v,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS nth
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)),
own AS (
  SELECT *, CASE
    WHEN regexp_matches(host || path, '^(?:[^/]*[.])?cheap[.-]pills[./]') THEN 'cheap-pills'
    WHEN regexp_matches(host || path, '^(?:[^/]*[.])?casino[.-]win[./]') THEN 'casino-win'
    WHEN regexp_matches(host || path, '^(?:[^/]*[.])?spam[.-]farm[./]') THEN 'spam-farm'
    WHEN regexp_matches(host || path, '^(?:[^/]*[.])?free[.-]bets[./]') THEN 'free-bets'
    WHEN regexp_matches(host || path, '^(?:[^/]*[.])?ads[.-]track[./]') THEN 'ads-track'
    WHEN regexp_matches(host || path, '/checkout(?:/|$)') THEN '/checkout'
    WHEN regexp_matches(host || path, '^(?:[^/]*[.])?adult[.-]x[./]') THEN 'adult-x'
    WHEN regexp_matches(host || path, '/signup(?:/|$)') THEN '/signup'
    WHEN regexp_matches(host || path, '/login(?:/|$)') THEN '/login'
    WHEN regexp_matches(host || path, '/cart(?:/|$)') THEN '/cart' END AS method_rule
  FROM fit WHERE nth = 1)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN method_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       method_rule
FROM own
""")
def op4_url_filter(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


@_query()
def op5_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


@_query(r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS x(k) GROUP BY r),
lines AS (
  SELECT r, x, len(regexp_split_to_array(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+')) AS n,
         len(list_distinct(regexp_split_to_array(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+'))) AS u,
         len(regexp_extract_all(x, '\|')) AS pipes, len(regexp_extract_all(x, '!{2,}')) AS shouts,
         len(regexp_extract_all(x, '[#*$%&|<>]')) AS syms
  FROM (SELECT r, unnest(l) AS x FROM d)),
judged AS (
  SELECT r, length(x) AS c, (pipes >= 3 AND pipes * 4 >= n) OR (shouts >= 3 AND shouts * 2 >= n)
         OR (syms >= 3 AND syms * 2 >= n) OR (n >= 12 AND u * 4 <= n)
         OR (n <= 25 AND regexp_matches(lower(x), 'cookie policy|uses cookies|enable javascript|all rights reserved|privacy policy|terms of use|terms of service|click here|read more|subscribe now|sign up now|share this'))
         OR NOT regexp_matches(x, '\p{L}') AS bad
  FROM lines),
loss AS (SELECT r, sum(c) AS c, sum(CASE WHEN bad THEN c ELSE 0 END) AS lost,
                sum(CASE WHEN bad THEN 1 ELSE 0 END) AS n_removed FROM judged GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(loss.n_removed, 0)::BIGINT AS n_removed_lines, coalesce(loss.c, 0) AS c, coalesce(loss.lost, 0) AS lost
  FROM d LEFT JOIN rep USING (r) LEFT JOIN loss USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * lost > 50 * c) AS kept, n_removed_lines
FROM m
""")
def op6_quality(spark, sf_dir):
    return quality.judge_quality(_table(spark, sf_dir, "documents"))


@_query()
def op3_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


@_query()
def op7_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@_query()
def op10_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return token_counts.length_histogram(counted)


@_query()
def op1_line_dedup(spark, sf_dir):
    return line_dedup.line_summary(_table(spark, sf_dir, "documents"))


@_query()
def op8_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query()
def op9_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


@_query()
def op11_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query(r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, x) AS (
  SELECT c, c::VARCHAR, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT c, s[2:], xor(x >> 8, list_reduce([xor(x & 255, ascii(s[1])::BIGINT), 1, 2, 3, 4, 5, 6, 7, 8],
                                           lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) FROM crc WHERE s <> ''),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 5 AS b, xor(x, 4294967295) % 9 AS h FROM crc WHERE s = ''),
r AS (
  SELECT h.c, 0 AS part, t.n, t.role, t.text FROM h JOIN t ON t.c = h.b AND t.n <= h.h
  UNION ALL
  SELECT h.c, 1, t.n, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.n > h.h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, n) AS d, role, text FROM r),
p AS (
  SELECT c, d, octet_length(encode(text)) AS bytes,
         string_agg(sha256(octet_length(encode(role)) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS pre FROM o
  UNION ALL SELECT c, 0, 0, '' FROM ids),
e AS (SELECT c, max(d) AS d FROM p GROUP BY c),
v AS (
  SELECT p.d, p.pre, min(p.c) AS conv_id, count(*) AS n, max(p.bytes) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN e.d = p.d THEN p.c::VARCHAR END, ',' ORDER BY p.c), '')) AS ends_sha256
  FROM p JOIN e USING (c) GROUP BY p.d, p.pre),
k AS (SELECT d - 1 AS d, left(pre, 64 * (d - 1)) AS pre, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL),
f AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN k USING (d, pre)),
up AS (SELECT unnest(range(0, d + 1)) AS a, d, pre, n, bytes, n_children FROM f),
s AS (
  SELECT a AS d, left(pre, 64 * a) AS pre, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum((n - 1) * bytes) AS saved_tokens
  FROM up GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.d = f.d AND s.pre = f.pre LEFT JOIN f AS q ON q.d = f.d - 1 AND q.pre = left(f.pre, 64 * (f.d - 1))
""")
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(prefix_trie.rebuilt_paths(_table(spark, sf_dir, "conversations")))


def _clustering_sql(rounds: int = 5, k: int = 40, size: int = 64) -> str:
    """The rounds one after the other. Squared distances are whole numbers below 2**53, so doubles hold them exactly."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS k, v AS c FROM v
  QUALIFY k < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, k, d FROM (
    SELECT r, vec_id, v, k, list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c) AS d FROM v, c{i})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < rounds:
            steps.append(f"""
n{i} AS (SELECT k, i, floor(sum(x) / count(*)) AS x FROM (SELECT k, unnest(v) AS x, unnest(range({size})) AS i FROM a{i}) GROUP BY k, i),
c{i + 1} AS MATERIALIZED (
  SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM n{i} GROUP BY k) AS m USING (k))""")
    return f"""WITH {','.join(steps)}
SELECT a.vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c USING (k)"""


@_query(_clustering_sql())
def op13_centroids(spark, sf_dir):
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), order=centroids.hash_order()).drop("centroid")
