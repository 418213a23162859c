"""Registered queries: id resolution (P8-P9, U3, J7, A30), text and JSON operators (TX1-TX7), chart tables
(V1-V11), sources and sinks (S1-S13), table overview (A14), period-key quality (A39), windowed event features."""

from __future__ import annotations

from pyspark.sql import functions as F

from termlens import config as C
from termlens.functions import text as TX
from termlens.functions.keys import looks_like_id, normalize_id
from termlens.operators import charts as CH
from termlens.operators import idmap as ID
from termlens.operators import profiles as PR
from termlens.plans import sql_exprs as X
from termlens.plans.registry import query
from termlens.plans.sql_bindings import CTES
from termlens.sources.tables import Tables

K = C.N_MODES
KEYS = ["entity_id", "period_key"]
GCOL = C.GROUP_LEVELS["major"]


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


# ---- id resolution ----

_NAME = "'Customer#' || lpad(CAST({k} AS VARCHAR), 9, '0')"
CTES["id_src"] = f"""
  SELECT 'orders' AS source_table, 'XSBH' AS source_field, {_NAME.format(k='o_custkey')} AS raw_id FROM orders
  UNION ALL SELECT 'orders', 'SID', '"' || {_NAME.format(k='o_custkey')} || '"' FROM orders
  UNION ALL SELECT 'events', 'LOGIN_NAME', lower({_NAME.format(k='user_id')}) FROM events
  UNION ALL SELECT 'lineitem', 'USERNUM', CAST(l_suppkey AS VARCHAR) || '.0' FROM lineitem
  UNION ALL SELECT 'part', 'KS_XH', 'PJ' || CAST(p_partkey AS VARCHAR) FROM part"""


def norm_id_sql(c: str) -> str:
    s = f"regexp_replace(coalesce(trim(CAST({c} AS VARCHAR)), ''), '^(\\d*)\\.0$', '\\1')"
    return (f"(CASE WHEN (starts_with({s}, '\"') AND ends_with({s}, '\"')) OR (starts_with({s}, '''') AND ends_with({s}, ''''))"
            f" THEN trim(CASE WHEN length({s}) >= 2 THEN substr({s}, 2, length({s}) - 2) ELSE '' END) ELSE {s} END)")


def like_id_sql(c: str) -> str:
    return f"coalesce(starts_with(lower({c}), 'pj') AND length({c}) >= 6, false)"


CTES["id_distinct"] = f"""
  SELECT DISTINCT source_table, source_field, {norm_id_sql('raw_id')} AS source_id FROM id_src
  WHERE {norm_id_sql('raw_id')} <> ''"""
CTES["id_master"] = f"""
  SELECT DISTINCT {norm_id_sql('c_name')} AS xh FROM customer WHERE {norm_id_sql('c_name')} <> ''"""
CTES["id_resolved"] = f"""
  SELECT d.source_table, d.source_field, d.source_id, coalesce(e.xh, l.xh, '') AS xh,
         CASE WHEN e.xh IS NOT NULL THEN 'exact' WHEN l.xh IS NOT NULL THEN 'lower_exact'
              WHEN {like_id_sql('d.source_id')} THEN 'xh_like_but_not_found' ELSE '' END AS match_method,
         CASE WHEN e.xh IS NOT NULL OR l.xh IS NOT NULL THEN 'high' WHEN {like_id_sql('d.source_id')} THEN 'low' ELSE '' END
           AS confidence
  FROM id_distinct d LEFT JOIN id_master e ON d.source_id = e.xh
  LEFT JOIN (SELECT lower(xh) AS lx, max(xh) AS xh FROM id_master GROUP BY 1) l ON lower(d.source_id) = l.lx"""


@query("normalize_id", f"SELECT source_table, source_field, {norm_id_sql('raw_id')} AS source_id, count(*) AS n FROM id_src GROUP BY ALL")
def q_normalize_id(spark, sf_dir):
    s = ID.id_sources(_t(spark, sf_dir))
    return s.groupBy("source_table", "source_field", normalize_id("raw_id").alias("source_id")).agg(F.count(F.lit(1)).alias("n"))


@query("looks_like_id", f"SELECT source_table, source_field, {like_id_sql('source_id')} AS id_like, count(*) AS n FROM id_distinct GROUP BY ALL")
def q_looks_like_id(spark, sf_dir):
    d = ID.distinct_ids(ID.id_sources(_t(spark, sf_dir)))
    return d.groupBy("source_table", "source_field", looks_like_id("source_id").alias("id_like")).agg(F.count(F.lit(1)).alias("n"))


@query("distinct_ids", "SELECT * FROM id_distinct")
def q_distinct_ids(spark, sf_dir):
    return ID.distinct_ids(ID.id_sources(_t(spark, sf_dir)))


@query("id_resolution", "SELECT * FROM id_resolved")
def q_id_resolution(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ID.id_resolution(ID.id_sources(t), ID.master_ids(t))


@query("id_match_coverage", """
SELECT coalesce(source_table, '__total__') AS source_table, coalesce(source_field, '__total__') AS source_field,
       count(*) AS n_distinct, count(*) FILTER (WHERE xh <> '') AS n_matched,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE xh <> '') / count(*) END AS rate
FROM id_resolved GROUP BY GROUPING SETS ((source_table, source_field), ())""")
def q_id_match_coverage(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ID.id_match_coverage(ID.id_resolution(ID.id_sources(t), ID.master_ids(t)))


# ---- text ----

# Fixed values of the message binding: keyword prefixes and field tags cycled by turn.
MSG_PREFIXES = ["页面解读：", "页面分析：", "请给出建议：", ""]
FIELD_TAGS = ["dim_academic", "p_mode_7", "mode_3_pct", "dim_extra_signal", "risk_pct", "kccj_fail_rate_avg"]


def _messages(spark, sf_dir):
    c = _t(spark, sf_dir).conversations
    pre = F.element_at(F.array(*[F.lit(p) for p in MSG_PREFIXES]), (F.col("turn") % len(MSG_PREFIXES) + 1).cast("int"))
    tag = F.element_at(F.array(*[F.lit(p) for p in FIELD_TAGS]), ((F.col("conv_id") + F.col("turn")) % len(FIELD_TAGS) + 1).cast("int"))
    return c.select("conv_id", "turn", "role", F.concat(pre, F.col("text")).alias("message"),
                    F.concat(F.lit("指标 "), tag, F.lit(" = 0.5 ; "), F.col("text")).alias("reply"))


_PRE = "[" + ", ".join(X.q(p) for p in MSG_PREFIXES) + "]"
_TAGS = "[" + ", ".join(X.q(p) for p in FIELD_TAGS) + "]"
CTES["messages"] = f"""
  SELECT conv_id, turn, role, {_PRE}[CAST(turn % {len(MSG_PREFIXES)} + 1 AS INTEGER)] || text AS message,
         '指标 ' || {_TAGS}[CAST((conv_id + turn) % {len(FIELD_TAGS)} + 1 AS INTEGER)] || ' = 0.5 ; ' || text AS reply
  FROM conversations"""


def _intent_sql(m: str) -> str:
    parts = []
    for intent, kws in TX.INTENT_RULES:
        parts.append("WHEN " + " OR ".join(f"contains(trim(coalesce({m}, '')), '{k}')" for k in kws) + f" THEN '{intent}'")
    return "CASE " + " ".join(parts) + f" ELSE '{TX.INTENT_DEFAULT}' END"


@query("classify_intent", f"SELECT conv_id, turn, {_intent_sql('message')} AS intent FROM messages")
def q_classify_intent(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", TX.classify_intent("message").alias("intent"))


def _mask_sql(t: str) -> str:
    out = f"coalesce(CAST({t} AS VARCHAR), '')"
    for k, v in TX.FIELD_LABELS.items():
        out = f"regexp_replace({out}, '\\b{k}\\b', '{v}', 'g')"
    out = f"regexp_replace({out}, '\\bp_mode_(\\d+)\\b', '模式\\1概率', 'g')"
    out = f"regexp_replace({out}, '\\bmode_(\\d+)_pct\\b', '模式\\1占比', 'g')"
    return f"regexp_replace({out}, '\\bdim_[a-z_]+\\b', '{TX.DIM_FALLBACK}', 'g')"


@query("mask_field_names", f"SELECT conv_id, turn, {_mask_sql('reply')} AS masked FROM messages")
def q_mask_field_names(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", TX.mask_field_names("reply").alias("masked"))


@query("strip_markup")
def q_strip_markup(spark, sf_dir):
    """TX3 (JS regex with look-aheads: no RE2/DuckDB form; unit-tested against hand-built cases)."""
    return _messages(spark, sf_dir).select("conv_id", "turn", TX.strip_markup("reply").alias("clean"))


@query("profile_payload_json")
def q_profile_payload_json(spark, sf_dir):
    """TX4: nested JSON per profile row (core, dimension scores, mode probabilities, extra metrics)."""
    p = PR.entity_profiles(_t(spark, sf_dir))
    core = F.struct("entity_id", "period_key", "XSM", "ZYM", "CLASS_NAME", "mode_id", "mode_name", "mode_pmax")
    dims = F.struct(*C.DIM_COLS)
    probs = F.map_from_arrays(F.array(*[F.lit(f"p_mode_{i}") for i in range(K)]), F.array(*[F.col(f"p_mode_{i}") for i in range(K)]))
    extra = F.struct(*C.KEY_METRICS)
    return p.select(*KEYS, F.to_json(F.struct(core.alias("core"), dims.alias("dim_scores"), probs.alias("mode_probabilities"),
                                             extra.alias("metrics"))).alias("payload"))


def _report_sql() -> str:
    r = X.risk_sql()
    return (f"'【' || {GCOL} || '】人数' || CAST(n_records AS VARCHAR) || '，风险占比' || printf('%.1f%%', round_even(({r}) * 100, 1))"
            f" || '，学业均值' || printf('%.1f', round_even(dim_academic_mean, 1))"
            f" || '，挂科率' || printf('%.1f%%', round_even(kccj_fail_rate_avg * 100, 1))")


@query("render_report_text", f"""
SELECT {GCOL}, angle, {_report_sql()} || '。' || CASE angle WHEN 'overview' THEN '请概述整体画像。' WHEN 'risk' THEN '请分析风险来源。'
       WHEN 'trend' THEN '请说明变化趋势。' ELSE '请给出可执行建议。' END AS prompt
FROM rollup_major, (VALUES ('overview'), ('risk'), ('trend'), ('advice')) a(angle)""")
def q_render_report_text(spark, sf_dir):
    from termlens.operators.serving import risk_leaderboard  # noqa: F401
    g = PR.group_profile_modes(PR.entity_profiles(_t(spark, sf_dir)), GCOL)
    r = PR.unweighted_rollup(g, GCOL, PR.group_numeric_cols())
    angles = {"overview": "请概述整体画像。", "risk": "请分析风险来源。", "trend": "请说明变化趋势。", "advice": "请给出可执行建议。"}
    a = F.explode(F.array(*[F.lit(k) for k in angles])).alias("angle")
    base = F.concat(F.lit("【"), F.col(GCOL), F.lit("】人数"), F.col("n_records").cast("string"), F.lit("，风险占比"),
                    TX.pct1(PR.risk_share()), F.lit("，学业均值"), TX.fmt1("dim_academic_mean"), F.lit("，挂科率"),
                    TX.pct1("kccj_fail_rate_avg"), F.lit("。"))
    amap = F.create_map(*[e for k, v in angles.items() for e in (F.lit(k), F.lit(v))])
    return r.select(GCOL, base.alias("_b"), a).select(GCOL, "angle", F.concat("_b", F.element_at(amap, F.col("angle"))).alias("prompt"))


@query("enrich_context", """
WITH req AS (SELECT level, group_name, period_key,
                    CASE WHEN n_records % 2 = 0 THEN json_object('context', json_object('group', json_object('lv', level, 'name', group_name, 'term', period_key)))
                         ELSE json_object('context', json_object('lv', level, 'group', group_name, 'term', period_key)) END AS payload
             FROM (""" + " UNION ALL ".join(
    f"SELECT '{lv}' AS level, CAST({col} AS VARCHAR) AS group_name, period_key, n_records FROM grp_{lv}"
    for lv, col in C.GROUP_LEVELS.items()) + """)),
p AS (SELECT coalesce(json_extract_string(payload, '$.context.group.lv'), json_extract_string(payload, '$.context.lv')) AS lv,
             coalesce(json_extract_string(payload, '$.context.group.name'), json_extract_string(payload, '$.context.group')) AS grp,
             coalesce(json_extract_string(payload, '$.context.group.term'), json_extract_string(payload, '$.context.term')) AS term
      FROM req),
g AS (""" + " UNION ALL ".join(
    f"SELECT '{lv}' AS level, CAST({col} AS VARCHAR) AS group_name, period_key, n_records, mode_1_pct, mode_6_pct FROM grp_{lv}"
    for lv, col in C.GROUP_LEVELS.items()) + """)
SELECT p.lv, p.grp, p.term, sum(g.n_records) AS n_records, avg(g.mode_1_pct) AS mode_1_pct, avg(g.mode_6_pct) AS mode_6_pct
FROM p JOIN g ON g.level = p.lv AND g.group_name = p.grp AND (p.term IS NULL OR p.term = '' OR g.period_key = p.term)
GROUP BY p.lv, p.grp, p.term""")
def q_enrich_context(spark, sf_dir):
    """TX6: request payloads (group given nested or flat) parsed with JSON paths and joined to the group rows
    of the same level / group / period, aggregated as the serving rollup."""
    from termlens.operators.serving import long_group_table
    g = long_group_table(PR.entity_profiles(_t(spark, sf_dir))).cache()
    nested = F.to_json(F.struct(F.struct(F.struct(F.col("level").alias("lv"), F.col("group_name").alias("name"),
                                                  F.col("period_key").alias("term")).alias("group")).alias("context")))
    flat = F.to_json(F.struct(F.struct(F.col("level").alias("lv"), F.col("group_name").alias("group"),
                                       F.col("period_key").alias("term")).alias("context")))
    req = g.select(F.when(F.col("n_records") % 2 == 0, nested).otherwise(flat).alias("payload"))
    j = F.get_json_object
    p = req.select(F.coalesce(j("payload", "$.context.group.lv"), j("payload", "$.context.lv")).alias("lv"),
                   F.coalesce(j("payload", "$.context.group.name"), j("payload", "$.context.group")).alias("grp"),
                   F.coalesce(j("payload", "$.context.group.term"), j("payload", "$.context.term")).alias("term"))
    cond = (g.level == p.lv) & (g.group_name == p.grp) & (p.term.isNull() | (p.term == "") | (g.period_key == p.term))
    return p.join(g, cond).groupBy(p.lv, p.grp, p.term).agg(
        F.sum("n_records").alias("n_records"), F.avg("mode_1_pct").alias("mode_1_pct"), F.avg("mode_6_pct").alias("mode_6_pct"))


@query("formula_catalog", "SELECT dim_id, metric, weight, direction, mean, sd FROM (VALUES " + ", ".join(
    f"('{d}', '{m}', {float(w)}, '{'+' if w > 0 else '-'}')" for d, comps in C.DIM_WEIGHTS.items() for m, w in comps)
    + ") c(dim_id, metric, weight, direction) JOIN (SELECT * FROM (SELECT " + ", ".join(
    f"avg(CAST({m} AS DOUBLE)) AS {m}__m, stddev_pop(CAST({m} AS DOUBLE)) AS {m}__s" for m in X.INPUTS)
    + " FROM mart) UNPIVOT ((mean, sd) FOR metric IN (" + ", ".join(f"({m}__m, {m}__s) AS '{m}'" for m in X.INPUTS)
    + "))) s USING (metric)")
def q_formula_catalog(spark, sf_dir):
    """TX7: the six formulas as rows (dimension, component, weight, direction) joined to each component's mean and
    population sd over the mart, i.e. the exact z-score parameters the scores use."""
    from termlens.operators.marts import build_feature_mart
    from termlens.operators.scores import zscore_fit
    cat = spark.createDataFrame([(d, m, float(w), "+" if w > 0 else "-") for d, comps in C.DIM_WEIGHTS.items()
                                 for m, w in comps], "dim_id string, metric string, weight double, direction string")
    par = zscore_fit(build_feature_mart(_t(spark, sf_dir)), X.INPUTS)
    ps = spark.createDataFrame([(m, v[0], v[1]) for m, v in par.items()], "metric string, mean double, sd double")
    return cat.join(ps, "metric").select("dim_id", "metric", "weight", "direction", "mean", "sd")


# ---- chart tables ----

def _hist_sql(col: str, series: str, lo: str, hi: str) -> str:
    w = f"(CASE WHEN {hi} = {lo} THEN 1.0 ELSE {hi} - {lo} END)"
    return f"""SELECT '{series}' AS series, bin, {lo} + bin * ({w} / 30) AS lo_edge, {lo} + (bin + 1) * ({w} / 30) AS hi_edge, count(*) AS n
FROM (SELECT CAST(least(floor((round_even({col}, 9) - {lo}) / {w} * 30), 29) AS INTEGER) AS bin FROM scored, r
      WHERE round_even({col}, 9) >= {lo} AND round_even({col}, 9) <= {hi}), r GROUP BY bin, {lo}, {hi}"""


@query("histogram", "WITH r AS (SELECT min(round_even(mode_pmax, 9)) AS plo, max(round_even(mode_pmax, 9)) AS phi, "
       "min(round_even(mode_entropy, 9)) AS elo, max(round_even(mode_entropy, 9)) AS ehi, "
       "0.95 AS zlo, 1.0 AS zhi, 0.0 AS z0, 0.1 AS z1 FROM scored) "
       + " UNION ALL ".join([_hist_sql("mode_pmax", "pmax", "plo", "phi"), _hist_sql("mode_entropy", "entropy", "elo", "ehi"),
                             _hist_sql("mode_pmax", "pmax_zoom", "zlo", "zhi"), _hist_sql("mode_entropy", "entropy_zoom", "z0", "z1")]))
def q_histogram(spark, sf_dir):
    s = PR.soft_labels(_t(spark, sf_dir)).select("mode_pmax", "mode_entropy").cache()
    out = CH.histogram(s, "mode_pmax", series="pmax").unionByName(CH.histogram(s, "mode_entropy", series="entropy")) \
        .unionByName(CH.histogram(s, "mode_pmax", lo=0.95, hi=1.0, series="pmax_zoom")) \
        .unionByName(CH.histogram(s, "mode_entropy", lo=0.0, hi=0.1, series="entropy_zoom"))
    return out


_WROLL = f"SELECT {GCOL}, " + ", ".join(
    f"sum({c} * coalesce(CAST(n_records AS DOUBLE), 1)) / sum(CASE WHEN {c} IS NOT NULL THEN coalesce(CAST(n_records AS DOUBLE), 1) END) AS {c}"
    for c in X.GROUP_NUMERIC) + f" FROM grp_major GROUP BY {GCOL}"


def _wroll(spark, sf_dir):
    g = PR.group_profile_modes(PR.entity_profiles(_t(spark, sf_dir)), GCOL)
    return PR.weighted_rollup(g, GCOL, PR.group_numeric_cols())


@query("stacked_group_modes", f"""SELECT {GCOL}, mode_id, share, share >= 0.08 AS show_label FROM (
SELECT {GCOL}, CAST(m AS INTEGER) AS mode_id, coalesce(CASE m {' '.join(f'WHEN {i} THEN mode_{i}_pct' for i in range(K))} END, 0) AS share
FROM ({_WROLL}), range({K}) t(m))""")
def q_stacked_group_modes(spark, sf_dir):
    return CH.stacked_group_modes(_wroll(spark, sf_dir), GCOL)


@query("group_dim_heatmap", f"""SELECT {GCOL}, dim, value, max(abs(value)) OVER () AS vmax FROM (
SELECT * FROM ({_WROLL}) UNPIVOT INCLUDE NULLS (value FOR dim IN ({', '.join(f'{d}_mean AS {X.q(d)}' for d in C.DIM_COLS)})))""")
def q_group_dim_heatmap(spark, sf_dir):
    return CH.group_dim_heatmap(_wroll(spark, sf_dir), GCOL)


@query("group_risk_split", f"""SELECT {GCOL}, coalesce(mode_1_pct, 0) AS mode_1_pct, coalesce(mode_6_pct, 0) AS mode_6_pct,
coalesce(mode_1_pct, 0) + coalesce(mode_6_pct, 0) AS risk_total FROM ({_WROLL}) ORDER BY risk_total, {GCOL}""")
def q_group_risk_split(spark, sf_dir):
    return CH.group_risk_split(_wroll(spark, sf_dir), GCOL)


@query("overall_mode_chart", "SELECT mode_id, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM scored GROUP BY mode_id")
def q_overall_mode_chart(spark, sf_dir):
    d = PR.mode_distribution(PR.soft_labels(_t(spark, sf_dir)))
    return d.select("mode_id", "n", (F.col("pct") * 100).alias("pct"))


@query("mode_radar", f"""SELECT mode_id, dim, value FROM (SELECT mode_id, {', '.join(f'avg({d}) AS {d}' for d in C.DIM_COLS)} FROM scored GROUP BY mode_id)
UNPIVOT INCLUDE NULLS (value FOR dim IN ({', '.join(C.DIM_COLS)}))""")
def q_mode_radar(spark, sf_dir):
    return CH.mode_radar(PR.mode_profile_dims(PR.soft_labels(_t(spark, sf_dir))))


@query("density_grid", """
WITH sc AS (SELECT mode_id, round_even(dim_academic, 9) AS dim_academic, round_even(dim_development, 9) AS dim_development FROM scored),
r AS (SELECT min(dim_academic) AS x0, max(dim_academic) AS x1, min(dim_development) AS y0, max(dim_development) AS y1 FROM sc),
big AS (SELECT mode_id FROM sc GROUP BY mode_id HAVING count(*) >= 30),
cells AS (SELECT s.mode_id, CAST(least(floor((dim_academic - x0) / CASE WHEN x1 = x0 THEN 1.0 ELSE x1 - x0 END * 240), 239) AS INTEGER) AS bin_x,
                 CAST(least(floor((dim_development - y0) / CASE WHEN y1 = y0 THEN 1.0 ELSE y1 - y0 END * 240), 239) AS INTEGER) AS bin_y,
                 count(*) AS n
          FROM sc s JOIN big USING (mode_id), r GROUP BY ALL),
lv AS (SELECT mode_id, quantile_cont(n, 0.92) AS level_core, quantile_cont(n, 0.82) AS level_cover FROM cells GROUP BY mode_id)
SELECT mode_id, bin_x, bin_y, n, level_core, level_cover FROM cells JOIN lv USING (mode_id)""")
def q_density_grid(spark, sf_dir):
    s = PR.soft_labels(_t(spark, sf_dir)).select("mode_id", "dim_academic", "dim_development")
    return CH.density_grid(s, "dim_academic", "dim_development", "mode_id")


@query("k_curves")
def q_k_curves(spark, sf_dir):
    """V9: curves over K (silhouette, Davies-Bouldin, mean ARI against the base seed; one fit for all) and the cumulative
    variance over the number of principal components."""
    from termlens.operators import cluster as CL
    from termlens.operators import prep as PP
    from termlens.plans.q_model import _screen_features
    z, keep = _screen_features(spark, sf_dir)
    metrics, stability = CL.kmeans_screening(z, keep)
    long = metrics.selectExpr("k AS x", "stack(2, 'silhouette', silhouette, 'davies_bouldin', davies_bouldin) AS (curve, value)")
    ari = stability.groupBy(F.col("k").alias("x")).agg(F.avg("ari_vs_base").alias("value")).withColumn("curve", F.lit("ari"))
    pca = PP.pca_fit(z, keep)[1].select(F.col("component").alias("x"), F.col("cumulative_ratio").alias("value"), F.lit("pca_cumulative").alias("curve"))
    return long.unionByName(ari).unionByName(pca).select("curve", "x", "value")


@query("projection_points")
def q_projection_points(spark, sf_dir):
    """2-D projection of the z-scaled dimension scores joined to the soft labels, opacity .15 + .85 p_max,
    one point per row."""
    from termlens.operators import prep as PP
    kept = [*KEYS, "mode_id", "mode_pmax"]                 # carried through both steps: no join back, no other column cached
    s = PR.soft_labels(_t(spark, sf_dir)).select(*kept, *C.DIM_COLS).cache()
    pts = PP.pca_project(PP.zscore_matrix(s, kept, C.DIM_COLS), kept, C.DIM_COLS, 2)
    pts = pts.select(*KEYS, "pc1", "pc2", "mode_id", (0.15 + 0.85 * F.col("mode_pmax")).alias("opacity"))
    return pts


ENTITY = "7"


@query("row_as_pairs", f"""
SELECT pos, metric, value FROM (
  SELECT row_number() OVER () - 1 AS pos, metric, value FROM (
    SELECT * FROM (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ['mode_id', 'mode_pmax', 'mode_margin', 'mode_entropy', 'subtype_id', *C.KEY_METRICS])}
                   FROM profiles WHERE entity_id = '{ENTITY}' ORDER BY period_key DESC LIMIT 1)
    UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(['mode_id', 'mode_pmax', 'mode_margin', 'mode_entropy', 'subtype_id', *C.KEY_METRICS])}))))""")
def q_row_as_pairs(spark, sf_dir):
    from termlens.operators.serving import latest_period
    p = PR.entity_profiles(_t(spark, sf_dir)).where(F.col("entity_id") == ENTITY)
    return CH.row_as_pairs(latest_period(p).drop("entity_id"))
