"""Registered queries: quality reports and feature preparation (A14-A17, A31-A33, F6-F8, P12-P13, T3-T4, T8,
X1-X14, W1-W3, U1-U4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from termlens.operators import prep as PP
from termlens.operators import quality as QL
from termlens.operators.marts import MART_COLUMNS, build_feature_mart, materialized_mart
from termlens.plans import sql_exprs  # noqa: F401  (registers the scored / profile CTEs)
from termlens.plans.registry import query
from termlens.plans.sql_bindings import MART_BIGINT
from termlens.sources import bindings as B
from termlens.sources.tables import Tables

KEYS = ["entity_id", "period_key"]
FEATS = MART_COLUMNS
_DBL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATS)
_DBL9 = ", ".join(f"round_even(CAST({c} AS DOUBLE), 9) AS {c}" for c in FEATS)
LONG9 = f"(SELECT * FROM (SELECT entity_id, period_key, {_DBL9} FROM mart) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATS)})))"
LONG = f"(SELECT * FROM (SELECT entity_id, period_key, {_DBL} FROM mart) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATS)})))"
POS = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(FEATS)) + " END"


def _mart(spark, sf_dir, materialize=True):
    t = Tables(spark, sf_dir)
    return materialized_mart(t) if materialize else build_feature_mart(t)


def _pos(col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(FEATS)) + " END"


# ---- quality ----

@query("feature_ranges", f"""
SELECT feature, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS missing_rate,
       avg(CASE WHEN coalesce(value, 0) = 0 THEN 1 ELSE 0 END) AS zero_rate, min(value) AS min,
       quantile_cont(value, 0.5) AS p50, avg(value) AS mean, quantile_cont(value, 0.95) AS p95,
       quantile_cont(value, 0.99) AS p99, max(value) AS max
FROM {LONG} GROUP BY feature""")
def q_feature_ranges(spark, sf_dir):
    return QL.feature_ranges(_mart(spark, sf_dir), FEATS)


_AUDIT = f"""SELECT feature, CASE WHEN feature IN ({', '.join(repr(c) for c in MART_BIGINT)}) THEN 'bigint' ELSE 'double' END AS dtype,
       count(*) AS n_total, count(*) - count(value) AS n_missing, (count(*) - count(value)) / count(*) AS missing_rate,
       count(value) AS n_numeric_parseable, count(value) / count(*) AS numeric_parse_rate,
       count(DISTINCT round_even(value, 9)) AS n_unique_nonnull
FROM {LONG} GROUP BY feature"""


@query("missing_audit", _AUDIT)
def q_missing_audit(spark, sf_dir):
    return QL.missing_audit(_mart(spark, sf_dir), FEATS)


@query("audit_summary", f"""
SELECT max(n_total) AS n_rows, {len(FEATS) + 2} AS n_cols_total, count(*) AS n_feature_cols,
       coalesce(avg(missing_rate), 0) AS avg_missing_rate, count(*) FILTER (WHERE missing_rate > 0.40) AS feature_missing_gt_40pct,
       count(*) FILTER (WHERE missing_rate > 0.60) AS feature_missing_gt_60pct
FROM ({_AUDIT})""")
def q_audit_summary(spark, sf_dir):
    a = QL.missing_audit(_mart(spark, sf_dir), FEATS)
    return QL.audit_summary(a, None, len(FEATS) + 2)


@query("whitelist_rule", f"""SELECT feature, missing_rate, numeric_parse_rate, n_unique_nonnull FROM ({_AUDIT})
WHERE missing_rate > 0 AND missing_rate <= 0.40 AND numeric_parse_rate >= 0.95 AND n_unique_nonnull >= 20""")
def q_whitelist_rule(spark, sf_dir):
    a = QL.missing_audit(_mart(spark, sf_dir), FEATS)
    return QL.whitelist_rule(a).select("feature", "missing_rate", "numeric_parse_rate", "n_unique_nonnull")


@query("keep_low_missing", f"SELECT feature, missing_rate FROM ({_AUDIT}) WHERE missing_rate <= 0.6")
def q_keep_low_missing(spark, sf_dir):
    return QL.keep_low_missing(QL.missing_rates(_mart(spark, sf_dir), FEATS))


@query("top_missing_features", f"SELECT feature, missing_rate FROM ({_AUDIT}) ORDER BY missing_rate DESC, feature LIMIT 20")
def q_top_missing(spark, sf_dir):
    a = QL.missing_rates(_mart(spark, sf_dir), FEATS)
    return a.orderBy(F.desc("missing_rate"), "feature").limit(20).select("feature", "missing_rate")


@query("missing_flags", "SELECT entity_id, period_key, " + ", ".join(
    f"CAST({c} IS NULL AS INTEGER) AS is_missing_{c}" for c in FEATS) + " FROM mart")
def q_missing_flags(spark, sf_dir):
    return QL.missing_flags(_mart(spark, sf_dir), KEYS, FEATS)


_HWCOLS = ["CREATER_TIME", "ANSWER_TIME", "CLASS_ID", "IS_UNGRADED"]


@query("is_missing_value", "SELECT feature, n_total, n_missing FROM (SELECT " + ", ".join(
    f"count(*) AS {c}__t, sum(CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' OR lower(trim(CAST({c} AS VARCHAR))) = 'nan' "
    f"THEN 1 ELSE 0 END) AS {c}__m" for c in _HWCOLS) + " FROM src_homework) UNPIVOT ((n_total, n_missing) FOR feature IN (" + ", ".join(
    f"({c}__t, {c}__m) AS '{c}'" for c in _HWCOLS) + "))")
def q_is_missing_value(spark, sf_dir):
    return QL.missing_value_counts(B.homework(Tables(spark, sf_dir)), _HWCOLS)


def _q(col: str, q: float) -> str:
    return f"quantile_cont({col}, {q})"


_SCALED_Q = ", ".join(f"{_q(c, 0.01)} AS lo_{c}, {_q(c, 0.99)} AS hi_{c}" for c in FEATS)


@query("outlier_summary", "SELECT feature, p01, p99, hi_rate, lo_rate FROM (SELECT " + ", ".join(
    f"any_value(lo_{c}) AS {c}__p01, any_value(hi_{c}) AS {c}__p99, avg(CASE WHEN {c} > hi_{c} THEN 1.0 ELSE 0.0 END) AS {c}__hi, "
    f"avg(CASE WHEN {c} < lo_{c} THEN 1.0 ELSE 0.0 END) AS {c}__lo" for c in FEATS)
    + f" FROM mart, (SELECT {_SCALED_Q} FROM mart)) UNPIVOT INCLUDE NULLS ((p01, p99, hi_rate, lo_rate) FOR feature IN ("
    + ", ".join(f"({c}__p01, {c}__p99, {c}__hi, {c}__lo) AS '{c}'" for c in FEATS) + "))")
def q_outlier_summary(spark, sf_dir):
    return QL.outlier_summary(_mart(spark, sf_dir), FEATS)


@query("top_outlier_features", "SELECT feature, greatest(hi_rate, lo_rate) AS rate FROM (SELECT " + ", ".join(
    f"avg(CASE WHEN {c} > hi_{c} THEN 1.0 ELSE 0.0 END) AS {c}__hi, avg(CASE WHEN {c} < lo_{c} THEN 1.0 ELSE 0.0 END) AS {c}__lo"
    for c in FEATS) + f" FROM mart, (SELECT {_SCALED_Q} FROM mart)) UNPIVOT INCLUDE NULLS ((hi_rate, lo_rate) FOR feature IN ("
    + ", ".join(f"({c}__hi, {c}__lo) AS '{c}'" for c in FEATS) + ")) ORDER BY rate DESC, feature LIMIT 20")
def q_top_outlier_features(spark, sf_dir):
    s = QL.outlier_summary(_mart(spark, sf_dir), FEATS)
    return s.select("feature", F.greatest("hi_rate", "lo_rate").alias("rate")).orderBy(F.desc("rate"), "feature").limit(20)


@query("outlier_samples", f"""
SELECT feature, entity_id, period_key, value, rank FROM (
  SELECT feature, entity_id, period_key, value,
         row_number() OVER (PARTITION BY feature ORDER BY value DESC, entity_id, period_key) AS rank
  FROM {LONG} WHERE value IS NOT NULL) WHERE rank <= 10""")
def q_outlier_samples(spark, sf_dir):
    m = _mart(spark, sf_dir)
    long = QL.best_cells(m, KEYS, FEATS, 10)
    top = QL.top_k_per_group(long, "feature", [F.desc("value"), F.asc("entity_id"), F.asc("period_key")], 10,
                             F.col("entity_id"))
    return top.select("feature", "entity_id", "period_key", "value", "rank")


@query("min_support", """
SELECT mode_id, count(*) AS n, count(*) >= 200 AS splittable FROM scored GROUP BY mode_id""")
def q_min_support(spark, sf_dir):
    from termlens.operators.profiles import soft_labels
    s = soft_labels(Tables(spark, sf_dir))
    return s.groupBy("mode_id").agg(F.count(F.lit(1)).alias("n")).select("mode_id", "n", (F.col("n") >= 200).alias("splittable"))


# ---- preparation ----

_MED = ", ".join(f"median({c}) AS med_{c}" for c in FEATS)


@query("median_impute", "SELECT entity_id, period_key, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), med_{c}) AS {c}" for c in FEATS) + ", " + ", ".join(
    f"CAST({c} IS NULL AS INTEGER) AS is_missing_{c}" for c in FEATS) + f" FROM mart, (SELECT {_MED} FROM mart)")
def q_median_impute(spark, sf_dir):
    return PP.median_impute(_mart(spark, sf_dir), KEYS, FEATS)


def _tiered_sql(cols):
    ok = ", ".join(f"avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.5 AS ok_{c}" for c in cols)
    t1 = ", ".join(f"CAST({c} AS DOUBLE) AS o_{c}, coalesce(CAST({c} AS DOUBLE), median({c}) OVER (PARTITION BY entity_id)) AS {c}"
                   for c in cols)
    t2 = ", ".join(f"o_{c}, coalesce({c}, median({c}) OVER (PARTITION BY period_key)) AS {c}" for c in cols)
    t3 = ", ".join(f"CASE WHEN (SELECT ok_{c} FROM pr) THEN coalesce({c}, coalesce((SELECT median({c}) FROM w2), 0)) "
                   f"ELSE o_{c} END AS {c}" for c in cols)
    return (f"WITH pr AS (SELECT {ok} FROM mart), w1 AS (SELECT entity_id, period_key, {t1} FROM mart), "
            f"w2 AS (SELECT entity_id, period_key, {t2} FROM w1) SELECT entity_id, period_key, {t3} FROM w2")


@query("tiered_impute", _tiered_sql(FEATS))
def q_tiered_impute(spark, sf_dir):
    r = PP.tiered_impute(_mart(spark, sf_dir), "entity_id", "period_key", FEATS)
    return r.data.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in FEATS])


def _tier_ctes() -> str:
    """o_ the value, e_ after entity medians, p_ after period medians."""
    e = ", ".join(f"CAST({c} AS DOUBLE) AS o_{c}, coalesce(CAST({c} AS DOUBLE), median({c}) OVER (PARTITION BY entity_id)) AS e_{c}" for c in FEATS)
    p = ", ".join(f"o_{c}, e_{c}, coalesce(e_{c}, median(e_{c}) OVER (PARTITION BY period_key)) AS p_{c}" for c in FEATS)
    return f"w1 AS (SELECT entity_id, period_key, {e} FROM mart), w2 AS MATERIALIZED (SELECT entity_id, period_key, {p} FROM w1)"


_LOG_SQL = f"WITH {_tier_ctes()} " + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, 1 - avg(CAST(o_{c} IS NOT NULL AS INTEGER)) AS missing_rate, avg(CAST(o_{c} IS NOT NULL AS INTEGER)) AS numeric_parse_rate,
  CASE WHEN avg(CAST(o_{c} IS NOT NULL AS INTEGER)) >= 0.5 THEN count(*) - count(o_{c}) ELSE 0 END AS imputed_total,
  CASE WHEN avg(CAST(o_{c} IS NOT NULL AS INTEGER)) >= 0.5 THEN count(*) FILTER (WHERE o_{c} IS NULL AND e_{c} IS NOT NULL) ELSE 0 END AS from_xh_median,
  CASE WHEN avg(CAST(o_{c} IS NOT NULL AS INTEGER)) >= 0.5 THEN count(*) FILTER (WHERE e_{c} IS NULL AND p_{c} IS NOT NULL) ELSE 0 END AS from_term_median,
  CASE WHEN avg(CAST(o_{c} IS NOT NULL AS INTEGER)) >= 0.5 THEN count(*) FILTER (WHERE p_{c} IS NULL) ELSE 0 END AS from_global_median,
  CAST(avg(CAST(o_{c} IS NULL AS INTEGER)) > 0.6 AS INTEGER) AS high_missing_feature,
  CASE WHEN avg(CAST(o_{c} IS NOT NULL AS INTEGER)) >= 0.5 THEN 'ok' ELSE 'skip_non_numeric_feature' END AS note FROM w2""" for c in FEATS)


@query("impute_log", _LOG_SQL)
def q_impute_log(spark, sf_dir):
    return PP.tiered_impute(_mart(spark, sf_dir), "entity_id", "period_key", FEATS).log


@query("whitelist_impute", f"""
WITH {_tier_ctes()}, wl AS (SELECT feature FROM ({_AUDIT}) WHERE missing_rate > 0 AND missing_rate <= 0.40 AND numeric_parse_rate >= 0.95 AND n_unique_nonnull >= 20)
SELECT entity_id, period_key, """ + ", ".join(
    f"CASE WHEN '{c}' IN (SELECT feature FROM wl) THEN coalesce(p_{c}, (SELECT median(p_{c}) FROM w2), 0) ELSE o_{c} END AS {c}, "
    f"CAST(o_{c} IS NULL AS INTEGER) AS is_missing_{c}" for c in FEATS) + " FROM w2")
def q_whitelist_impute(spark, sf_dir):
    m = _mart(spark, sf_dir)
    wl = [r["feature"] for r in QL.whitelist_rule(QL.missing_audit(m, FEATS)).select("feature").collect()]
    got = PP.tiered_impute(m, "entity_id", "period_key", FEATS, only=wl).data
    return got.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in FEATS], *[f"is_missing_{c}" for c in FEATS])


@query("impute_impact")
def q_impute_impact(spark, sf_dir):
    m = _mart(spark, sf_dir)
    after = PP.tiered_impute(m, "entity_id", "period_key", FEATS).data
    return QL.impute_impact(m, after, FEATS)


_WQ = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in FEATS)
_CLIP = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), lo_{c}), hi_{c}) END AS {c}"
                  for c in FEATS)


@query("winsorize", f"SELECT entity_id, period_key, {_CLIP} FROM mart, (SELECT {_WQ} FROM mart)")
def q_winsorize(spark, sf_dir):
    return PP.winsorize(_mart(spark, sf_dir), KEYS, FEATS)


_RQ = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS md_{c}, quantile_cont({c}, 0.75) AS q3_{c}"
                for c in FEATS)


@query("robust_scale", f"""WITH clipped AS (SELECT entity_id, period_key, {_CLIP} FROM mart, (SELECT {_WQ} FROM mart))
SELECT entity_id, period_key, """ + ", ".join(
    f"({c} - md_{c}) / CASE WHEN q3_{c} - q1_{c} = 0 OR q3_{c} IS NULL THEN 1 ELSE q3_{c} - q1_{c} END AS {c}" for c in FEATS)
    + f" FROM clipped, (SELECT {_RQ} FROM clipped)")
def q_robust_scale(spark, sf_dir):
    return PP.robust_scale(_mart(spark, sf_dir), KEYS, FEATS)[0]


@query("sink_params", "SELECT " + " UNION ALL SELECT ".join(
    f"'{c}' AS feature, lo_{c} AS q_low, hi_{c} AS q_high, md_{c} AS median, "
    f"CASE WHEN q3_{c} - q1_{c} = 0 OR q3_{c} IS NULL THEN 1 ELSE q3_{c} - q1_{c} END AS iqr "
    f"FROM (SELECT {_WQ} FROM mart), (SELECT {_RQ} FROM (SELECT {_CLIP} FROM mart, (SELECT {_WQ} FROM mart)))" for c in FEATS))
def q_sink_params(spark, sf_dir):
    """Scale parameters written as a small Parquet table under the checkpoint folder and read back."""
    from termlens.sources import files
    params = PP.robust_scale(_mart(spark, sf_dir), KEYS, FEATS)[1]
    return files.write_and_read_params(params, "robust_scale")


@query("drop_low_variance", "SELECT feature, variance, variance <= 1e-8 AS is_dropped FROM (SELECT " + ", ".join(
    f"var_pop(coalesce(CAST({c} AS DOUBLE), med_{c})) AS {c}" for c in FEATS) + f" FROM mart, (SELECT {_MED} FROM mart)) "
    f"UNPIVOT INCLUDE NULLS (variance FOR feature IN ({', '.join(FEATS)}))")
def q_drop_low_variance(spark, sf_dir):
    return PP.drop_low_variance(_mart(spark, sf_dir), FEATS)


@query("drop_columns", "SELECT feature FROM (SELECT " + ", ".join(
    f"var_pop(coalesce(CAST({c} AS DOUBLE), med_{c})) AS {c}" for c in FEATS) + f" FROM mart, (SELECT {_MED} FROM mart)) "
    f"UNPIVOT INCLUDE NULLS (variance FOR feature IN ({', '.join(FEATS)})) WHERE NOT coalesce(variance <= 1e-8, false)")
def q_drop_columns(spark, sf_dir):
    """U4: the column set left after dropping the low-variance report's columns (set difference, as rows)."""
    m = _mart(spark, sf_dir)
    drop = [r["feature"] for r in PP.drop_low_variance(m, FEATS).where("is_dropped").collect()]
    kept = m.drop(*drop)
    return spark.createDataFrame([(c,) for c in kept.columns if c in FEATS], "feature string")


@query("equalize_variance", "SELECT entity_id, period_key, " + ", ".join(
    f"CAST({c} AS DOUBLE) / CASE WHEN sd_{c} IS NULL OR sd_{c} <= 1e-12 THEN 1 ELSE sd_{c} END AS {c}" for c in FEATS)
    + " FROM mart, (SELECT " + ", ".join(f"stddev_pop({c}) AS sd_{c}" for c in FEATS) + " FROM mart)")
def q_equalize_variance(spark, sf_dir):
    return PP.equalize_variance(_mart(spark, sf_dir), KEYS, FEATS)


@query("flag_outliers", "SELECT entity_id, period_key, " + ", ".join(FEATS) + ", " + ", ".join(
    f"coalesce(CAST({c} > hi_{c} AS INTEGER), 0) AS is_outlier_hi_{c}, coalesce(CAST({c} < lo_{c} AS INTEGER), 0) AS is_outlier_lo_{c}"
    for c in FEATS) + f" FROM mart, (SELECT {_WQ} FROM mart)")
def q_flag_outliers(spark, sf_dir):
    return PP.flag_outliers(_mart(spark, sf_dir), KEYS, FEATS)


# ---- the whole chain: fill, winsorise, scale, drop, equalise, prune, flag ----

def _chain_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]
    each = lambda f: ", ".join(f(c) for c in FEATS)
    gone = "CASE WHEN ends_with(lower(a), '_median') AND ends_with(lower(b), '_mean') THEN a ELSE b END"
    return f"""
WITH m AS (SELECT {each(lambda c: f"median({c}) AS {c}")} FROM mart),
f AS MATERIALIZED (SELECT entity_id, period_key, {each(lambda c: f"coalesce(CAST(x.{c} AS DOUBLE), m.{c}) AS {c}")} FROM mart AS x, m),
w AS (SELECT {each(lambda c: f"quantile_cont({c}, 0.01) AS l_{c}, quantile_cont({c}, 0.99) AS h_{c}")} FROM f),
k AS MATERIALIZED (SELECT entity_id, period_key, {each(lambda c: f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, l_{c}), h_{c}) END AS {c}")} FROM f, w),
r AS (SELECT {each(lambda c: f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i_{c}")} FROM k),
s AS MATERIALIZED (SELECT entity_id, period_key, {each(lambda c: f"({c} - m_{c}) / CASE WHEN i_{c} IS NULL OR i_{c} = 0 THEN 1 ELSE i_{c} END AS {c}")} FROM k, r),
v AS (SELECT {each(lambda c: f"var_pop({c}) AS v_{c}, stddev_pop({c}) AS d_{c}")} FROM s),
e AS MATERIALIZED (SELECT entity_id, period_key, {each(lambda c: f"{c} / CASE WHEN d_{c} IS NULL OR d_{c} <= 1e-12 THEN 1 ELSE d_{c} END AS {c}")} FROM s, v),
low AS (SELECT feature FROM (SELECT {each(lambda c: f"v_{c} AS {c}")} FROM v) UNPIVOT (variance FOR feature IN ({', '.join(FEATS)})) WHERE variance <= 1e-8),
rk AS MATERIALIZED (SELECT {each(lambda c: f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}")} FROM e),
co AS (SELECT {', '.join(f"CASE WHEN count({a}) >= 500 AND count({b}) >= 500 THEN corr({a}, {b}) END AS p{i}" for i, (a, b) in enumerate(pairs))} FROM rk),
cl AS (SELECT list_extract(a, CAST(substr(p, 2) AS INTEGER) + 1) AS a, list_extract(b, CAST(substr(p, 2) AS INTEGER) + 1) AS b, c FROM
  (SELECT {"[" + ", ".join(f"'{a}'" for a, _ in pairs) + "]"} AS a, {"[" + ", ".join(f"'{b}'" for _, b in pairs) + "]"} AS b, p, c FROM
   (SELECT * FROM co UNPIVOT (c FOR p IN ({', '.join(f'p{i}' for i in range(len(pairs)))}))))),
gone AS (SELECT {gone} AS feature FROM cl WHERE NOT isnan(c) AND abs(c) > 0.9 AND a NOT IN (SELECT feature FROM low) AND b NOT IN (SELECT feature FROM low)),
q AS (SELECT {each(lambda c: f"quantile_cont({c}, 0.01) AS l_{c}, quantile_cont({c}, 0.99) AS h_{c}")} FROM e),
z AS (SELECT entity_id, period_key, unnest([{each(lambda c: f"{{'feature': '{c}', 'value': {c}, 'lo': l_{c}, 'hi': h_{c}}}")}]) AS u FROM e, q)
SELECT entity_id, period_key, u.feature AS feature, u.value AS value, coalesce(CAST(u.value > u.hi AS INTEGER), 0) AS is_outlier_hi,
       coalesce(CAST(u.value < u.lo AS INTEGER), 0) AS is_outlier_lo
FROM z WHERE u.feature NOT IN (SELECT feature FROM low) AND u.feature NOT IN (SELECT feature FROM gone)"""


@query("prep_chain", _chain_sql())
def q_prep_chain(spark, sf_dir):
    """Fit the chain, store it with a version, load it and replay it: values and outlier flags of the kept features."""
    from termlens.operators import prep_chain as PC
    from termlens.sources import files
    mart = _mart(spark, sf_dir)
    path = PC.fit_chain(mart, KEYS, FEATS).save(spark, files.scratch_path(spark, "chain"), "1")
    return PC.PrepChain.load(spark, path).long(mart, KEYS)


@query("zscore_matrix", "WITH f AS (SELECT entity_id, period_key, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), med_{c}) AS {c}" for c in FEATS) + f" FROM mart, (SELECT {_MED} FROM mart)) "
    "SELECT entity_id, period_key, " + ", ".join(
    f"({c} - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1 ELSE s_{c} END AS {c}" for c in FEATS)
    + " FROM f, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS) + " FROM f)")
def q_zscore_matrix(spark, sf_dir):
    return PP.zscore_matrix(_mart(spark, sf_dir), KEYS, FEATS)


_PAIRS_SQL = f"""
WITH long AS (SELECT * FROM {LONG9} WHERE value IS NOT NULL),
pairs AS (SELECT a.feature AS fa, b.feature AS fb, a.value AS va, b.value AS vb
          FROM long a JOIN long b ON a.entity_id = b.entity_id AND a.period_key = b.period_key
          WHERE {_pos('a.feature')} < {_pos('b.feature')}),
ranked AS (SELECT fa, fb,
             rank() OVER (PARTITION BY fa, fb ORDER BY va) + (count(*) OVER (PARTITION BY fa, fb, va) - 1) / 2.0 AS ra,
             rank() OVER (PARTITION BY fa, fb ORDER BY vb) + (count(*) OVER (PARTITION BY fa, fb, vb) - 1) / 2.0 AS rb
           FROM pairs),
stats AS (SELECT fa, fb, count(*) AS n, corr(ra, rb) AS c FROM ranked GROUP BY fa, fb),
allp AS (SELECT x.f AS a, y.f AS b FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(FEATS))}) x(f, i),
                                     (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(FEATS))}) y(f, i) WHERE x.i < y.i)
SELECT allp.a, allp.b, coalesce(stats.n, 0) AS n,
       CASE WHEN stats.n >= 500 AND NOT isnan(stats.c) THEN stats.c END AS corr
FROM allp LEFT JOIN stats ON allp.a = stats.fa AND allp.b = stats.fb"""


@query("spearman_matrix", _PAIRS_SQL)
def q_spearman_matrix(spark, sf_dir):
    return PP.spearman_matrix(_mart(spark, sf_dir), KEYS, FEATS)


@query("corr_long", f"SELECT a, b, corr FROM ({_PAIRS_SQL}) WHERE corr IS NOT NULL")
def q_corr_long(spark, sf_dir):
    """V6: correlation in long form for a heatmap (defined pairs only)."""
    return PP.spearman_matrix(_mart(spark, sf_dir), KEYS, FEATS).where(F.col("corr").isNotNull()).select("a", "b", "corr")


@query("prune_redundant", f"""
SELECT a, b, corr, CASE WHEN lower(a) LIKE '%\\_median' ESCAPE '\\' AND lower(b) LIKE '%\\_mean' ESCAPE '\\' THEN a
                        WHEN lower(b) LIKE '%\\_median' ESCAPE '\\' AND lower(a) LIKE '%\\_mean' ESCAPE '\\' THEN b ELSE b END AS "drop"
FROM ({_PAIRS_SQL}) WHERE corr IS NOT NULL AND abs(corr) > 0.9""")
def q_prune_redundant(spark, sf_dir):
    c = PP.spearman_matrix(_mart(spark, sf_dir), KEYS, FEATS)
    return PP.prune_redundant(c, FEATS)


@query("partition_median", """
SELECT m.entity_id, m.period_key, m.kccj_mean, e.entity_median
FROM mart m LEFT JOIN (SELECT entity_id, median(kccj_mean) AS entity_median FROM mart GROUP BY entity_id) e
  ON m.entity_id IS NOT DISTINCT FROM e.entity_id""")
def q_partition_median(spark, sf_dir):
    m = _mart(spark, sf_dir).select(*KEYS, "kccj_mean")
    return PP.partition_median(m, "entity_id", "kccj_mean", "entity_median")


@query("first_per_key", """
SELECT entity_id, period_key, kccj_mean FROM (
  SELECT entity_id, period_key, kccj_mean, row_number() OVER (PARTITION BY entity_id ORDER BY period_key) AS rn FROM mart)
WHERE rn = 1""")
def q_first_per_key(spark, sf_dir):
    m = _mart(spark, sf_dir).select(*KEYS, "kccj_mean")
    return PP.first_per_key(m, "entity_id", [F.col("period_key")])


def _screen(spark, sf_dir):
    """Screening features: <= 60 % missing (F7), median-filled and z-scaled (X1 + X14)."""
    m = _mart(spark, sf_dir)
    keep = [r["feature"] for r in QL.keep_low_missing(QL.missing_rates(m, FEATS)).collect()]
    return PP.zscore_matrix(m, KEYS, keep), keep


@query("pca_fit")
def q_pca_fit(spark, sf_dir):
    z, keep = _screen(spark, sf_dir)
    return PP.pca_fit(z, keep, 20)[1].select("component", "explained_ratio")


@query("cumulative_variance")
def q_cumulative_variance(spark, sf_dir):
    z, keep = _screen(spark, sf_dir)
    return PP.pca_fit(z, keep, 20)[1]


@query("pca_project")
def q_pca_project(spark, sf_dir):
    z, keep = _screen(spark, sf_dir)
    return PP.pca_project(z, KEYS, keep, 2)


@query("sample_rows")
def q_sample_rows(spark, sf_dir):
    return PP.sample_rows(_mart(spark, sf_dir), KEYS, 4000, seed=42).select(*KEYS, "kccj_mean")


@query("union_rows", """
SELECT 'homework' AS src, CREATER_LOGIN_NAME AS XH, CLASS_ID AS cid, NULL AS extra FROM src_homework
UNION ALL SELECT 'signin', LOGIN_NAME, CLASSID, CAST(ACTIVE_STATE AS VARCHAR) FROM src_signin""")
def q_union_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hw = B.homework(t).select(F.lit("homework").alias("src"), F.col("CREATER_LOGIN_NAME").alias("XH"), F.col("CLASS_ID").alias("cid"))
    si = B.signin(t).select(F.lit("signin").alias("src"), F.col("LOGIN_NAME").alias("XH"), F.col("CLASSID").alias("cid"),
                            F.col("ACTIVE_STATE").cast("string").alias("extra"))
    return hw.unionByName(si, allowMissingColumns=True)


@query("hstack_columns", "SELECT entity_id, period_key, kccj_mean, CAST(att_event_cnt IS NULL AS INTEGER) AS is_missing_att_event_cnt FROM mart")
def q_hstack_columns(spark, sf_dir):
    m = _mart(spark, sf_dir)
    return m.select(*KEYS, "kccj_mean", F.col("att_event_cnt").isNull().cast("int").alias("is_missing_att_event_cnt"))
