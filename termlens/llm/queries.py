"""Registered queries of the training-data operators (opN_<name>) with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import (bitplane, decontaminate, fingerprint, language_id, lm_score, ngram_join, packing, pii, sharding, simhash,
                          substring, trie_codes, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- op1

#: fixed values: the rules of the contract as (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: fixed values: first labels of the hosts whose pages make up the list of canonical URLs
LISTED_HOSTS = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")

_OP1 = rf"""
WITH p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {_LOWER}) AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
q AS (SELECT *, list_filter(string_split(regexp_extract(coalesce(url, ''), '://[^?#]*\?([^#]*)', 1), '&'),
             lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_source|utm_medium|utm_campaign|utm_term|utm_content|ref|fbclid|gclid)(?:=|$)')) AS args FROM h),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(?:www\.|m\.)', '') || regexp_replace(path, '/+$', '')
             || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical FROM q),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '^(?:(?:www|m|blog)\.)?(?:ads-track|casino-win|spam-farm|adult-x|cheap-pills|free-bets)\.')),
r AS (SELECT c.page_id, c.host, c.path, l.canonical IS NOT NULL AS listed,
  CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r"""


@query("op1_url_filter", _OP1)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_path(F.col("url"))
    on_list = host.rlike(r"^(?:(?:www|m|blog)\.)?(?:" + "|".join(LISTED_HOSTS) + r")\.")
    listed = pages.where(on_list).select(url_filter.canonical(F.col("url"), host, path).alias("canonical"))
    return url_filter.url_filter(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# ---------------------------------------------------------------- op2

@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op3

@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op4

@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


# ---------------------------------------------------------------- op5

@query("op5_fingerprint")
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op6

_OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, k, sha256(array_to_string(ws[k:k + 34], ' ')) AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 34)) AS k FROM d WHERE len(ws) >= 35)),
r AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(generate_series(k, k + 34)) AS p FROM w SEMI JOIN r ON w.g = r.g),
x AS (SELECT rid, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM x ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""


@query("op6_substring_dedup", _OP6)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


# ---------------------------------------------------------------- op7

@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op8

TOKENIZER = "byte_bpe_50k.json"


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


# ---------------------------------------------------------------- op9

_WORDS9 = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS9} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS9} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, m, array_to_string(ws[k:k + m - 1], ' ') AS g FROM
  (SELECT item, ws, least(len(ws), 10) AS m, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS k FROM i WHERE len(ws) > 0)),
dw AS (SELECT rid, m, k, array_to_string(ws[k:k + m - 1], ' ') AS g FROM
  (SELECT rid, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m)),
occ AS (SELECT rid, dw.m, k, item FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(k, k + m - 1)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)"""


@query("op9_decontaminate", _OP9)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---------------------------------------------------------------- op10

@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op11

def _kept_sql(cond: str) -> str:
    return f"{cond} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


def _centroid_sql(k: int, rounds: int, scale: int, salt: str) -> str:
    d2 = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    ctes = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
             FROM embeddings WHERE {_kept_sql("len(embedding) = 64")})""",
            f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS c, q FROM v
             QUALIFY row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) <= {k})"""]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT rid, min({d2} * {k} + c.c) AS m FROM v, c{r} AS c GROUP BY rid)")
        if r < rounds:
            ctes.append(f"""s{r} AS (SELECT m % {k} AS c, p, sum(x) AS s, count(*) AS n FROM
             (SELECT m, unnest(q) AS x, unnest(generate_series(1, 64)) AS p FROM a{r} JOIN v USING (rid)) GROUP BY ALL),
             n{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS q FROM s{r} GROUP BY c),
             c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{r} AS o LEFT JOIN n{r} AS n USING (c))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, m // {k} AS distance, CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
       CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} AS c ON c.c = m % {k}"""


@query("op11_bit_planes", _centroid_sql(40, 5, 256, "2:"))
def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.cluster_report(table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- op12

def _codes_sql(parts: int, entries: int, rounds: int, scale: int, width: int) -> str:
    d2 = "CAST(list_sum(list_transform(list_zip(x.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    ctes = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
             FROM embeddings WHERE {_kept_sql("embedding IS NOT NULL")})""",
            f"x AS MATERIALIZED (SELECT rid, p, q[{width} * p + 1:{width} * p + {width}] AS q FROM v, (SELECT unnest(generate_series(0, {parts - 1})) AS p))",
            f"b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, q FROM x WHERE rid <= {entries})"]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT rid, x.p, min({d2} * {entries} + e) AS m FROM x JOIN b{r} AS b ON x.p = b.p GROUP BY rid, x.p)")
        if r < rounds:
            ctes.append(f"""s{r} AS (SELECT p, m % {entries} AS e, i, sum(y) AS s, count(*) AS n FROM
             (SELECT p, m, unnest(q) AS y, unnest(generate_series(1, {width})) AS i FROM a{r} JOIN x USING (rid, p)) GROUP BY ALL),
             n{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{r} GROUP BY p, e),
             b{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.q, o.q) AS q FROM b{r} AS o LEFT JOIN n{r} AS n ON o.p = n.p AND o.e = n.e)""")
    return "WITH " + ",\n".join(ctes) + f""",
w AS (SELECT rid, string_agg(format('{{:02x}}', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
k AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM w JOIN v USING (rid), k"""


@query("op12_trie_codes", _codes_sql(8, 16, 6, 4096, 8))
def op12_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_codes.code_report(table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- op13

_OP13 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(ws[k:k + 2], ' ') AS g FROM (SELECT rid, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS k FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM g GROUP BY rid),
o AS (SELECT x.rid AS a, y.rid AS b, count(*) AS o FROM g AS x JOIN g AS y ON x.g = y.g AND x.rid < y.rid GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n AS p ON p.rid = a JOIN n AS q ON q.rid = b WHERE 100 * o >= 90 * (p.n + q.n - o)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, t.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) AS t ON r.b = t.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (rid)
JOIN (SELECT r.a AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a) AS c USING (rid)"""


@query("op13_ngram_join", _OP13)
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))
