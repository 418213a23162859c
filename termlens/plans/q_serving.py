"""Registered queries: scores, soft-label columns, profiles, group tables, serving lookups and rankings
(P15-P34, E4, A18-A29, A36-A38, F2-F11, W5-W8, T1-T8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termlens import config as C
from termlens.functions.nulls import np_round
from termlens.operators import profiles as PR
from termlens.operators import scores as S
from termlens.operators import serving as SV
from termlens.plans import sql_exprs as X
from termlens.plans.registry import query
from termlens.sources.tables import Tables

K = C.N_MODES
P_COLS = X.P_COLS
KEYS = ["entity_id", "period_key"]
LEVEL = "major"                      # default level of single-level group queries
GCOL = C.GROUP_LEVELS[LEVEL]


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _scored(spark, sf_dir):
    return PR.soft_labels(_t(spark, sf_dir))


def _profiles(spark, sf_dir):
    return PR.entity_profiles(_t(spark, sf_dir))


def _groups(spark, sf_dir, level=LEVEL):
    return PR.group_profile_modes(_profiles(spark, sf_dir), C.GROUP_LEVELS[level])


# ---- scores and soft-label columns ----

@query("zscore", "SELECT entity_id, period_key, " + ", ".join(f"{X.z_sql(c)} AS z_{c}" for c in X.INPUTS)
       + " FROM mart, zstats zs")
def q_zscore(spark, sf_dir):
    from termlens.operators.marts import materialized_mart
    m = materialized_mart(_t(spark, sf_dir))
    return S.zscore(m, X.INPUTS, keep=KEYS, suffix="") .select(*KEYS, *[F.col(c).alias(f"z_{c}") for c in X.INPUTS])


@query("dimension_scores", "SELECT entity_id, period_key, " + ", ".join(C.DIM_COLS) + " FROM scored")
def q_dimension_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select(*KEYS, *C.DIM_COLS)


@query("uncertainty", "SELECT entity_id, period_key, mode_pmax, mode_margin, mode_entropy FROM scored")
def q_uncertainty(spark, sf_dir):
    return _scored(spark, sf_dir).select(*KEYS, "mode_pmax", "mode_margin", "mode_entropy")


@query("normalized_entropy", f"SELECT entity_id, period_key, mode_entropy / ln({K}) AS entropy_norm FROM scored")
def q_normalized_entropy(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select(*KEYS, S.normalized_entropy(S.p_array(P_COLS)).alias("entropy_norm"))


@query("hard_label", "SELECT entity_id, period_key, mode_id FROM scored")
def q_hard_label(spark, sf_dir):
    return _scored(spark, sf_dir).select(*KEYS, "mode_id")


@query("subtype_codec", """
SELECT subtype_id, subtype_note, CAST(floor(subtype_id / 100) AS INTEGER) AS mode_part,
       CAST(subtype_id % 100 AS INTEGER) AS local_part, count(*) AS n FROM scored GROUP BY ALL""")
def q_subtype_codec(spark, sf_dir):
    s = _scored(spark, sf_dir)
    mp, lp = S.subtype_parts("subtype_id")
    return s.groupBy("subtype_id", "subtype_note", mp.alias("mode_part"), lp.alias("local_part")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("label_lookup", f"SELECT entity_id, period_key, mode_id, {X.mode_name_sql('mode_id')} AS mode_name, subtype_id, {X.subtype_name_sql('subtype_id')} AS subtype_name FROM scored")
def q_label_lookup(spark, sf_dir):
    return _scored(spark, sf_dir).select(*KEYS, "mode_id", PR.mode_name_expr("mode_id").alias("mode_name"), "subtype_id",
                                         PR.subtype_name_expr("subtype_id").alias("subtype_name"))


@query("score_level", "SELECT entity_id, period_key, " + ", ".join(
    f"{X.score_level_sql(d)} AS {d}_level" for d in C.DIM_COLS) + " FROM scored")
def q_score_level(spark, sf_dir):
    return _scored(spark, sf_dir).select(*KEYS, *[S.score_level(d).alias(f"{d}_level") for d in C.DIM_COLS])


@query("evidence_text", f"SELECT entity_id, period_key, {X.evidence_sql()} AS mode_evidence FROM scored")
def q_evidence_text(spark, sf_dir):
    return _scored(spark, sf_dir).select(*KEYS, S.evidence_text().alias("mode_evidence"))


@query("confidence_band", """
SELECT entity_id, period_key,
       CASE WHEN mode_pmax >= 0.8 THEN 'high' WHEN mode_pmax >= 0.6 THEN 'medium' WHEN mode_pmax >= 0.4 THEN 'low'
            ELSE 'very_low' END AS confidence,
       CASE WHEN mode_pmax < 0.6 THEN list_sort(list_transform(
            [p_mode_0, p_mode_1, p_mode_2, p_mode_3, p_mode_4, p_mode_5, p_mode_6, p_mode_7],
            lambda x, i: {'np': -x, 'i': i - 1}))[2].i END AS second_mode_id
FROM scored""")
def q_confidence_band(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select(*KEYS, SV.confidence_band("mode_pmax").alias("confidence"),
                    F.when(F.col("mode_pmax") < 0.6, SV.ranked_modes(P_COLS)[1]["i"]).alias("second_mode_id"))


# ---- profiles ----

@query("student_profiles", "SELECT * FROM profiles")
def q_student_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir)


@query("round_floats", "SELECT entity_id, period_key, " + ", ".join(
    f"round_even(CAST({c} AS DOUBLE), 4) AS {c}" for c in ["mode_pmax", "mode_margin", "mode_entropy", *C.DIM_COLS]) + " FROM scored")
def q_round_floats(spark, sf_dir):
    s = _scored(spark, sf_dir).select(*KEYS, "mode_pmax", "mode_margin", "mode_entropy", *C.DIM_COLS)
    return PR.round_floats(s, 4)


@query("most_frequent_class", "SELECT XH AS entity_id, CLASS_ID, CLASS_NAME, class_votes FROM class_map")
def q_most_frequent_class(spark, sf_dir):
    return PR.most_frequent_class(_t(spark, sf_dir)).withColumnRenamed("XH", "entity_id")


@query("attach_attributes", """
SELECT s.entity_id, s.period_key, s.mode_id, b.XB, b.XSM, b.ZYM, c.CLASS_NAME
FROM scored s LEFT JOIN src_basic_info b ON s.entity_id = b.XH LEFT JOIN class_map c ON s.entity_id = c.XH""")
def q_attach_attributes(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = PR.soft_labels(t).select(*KEYS, "mode_id")
    from termlens.sources import bindings as B
    b = SV.assert_unique(B.basic_info(t), "XH").select(F.col("XH").alias("entity_id"), "XB", "XSM", "ZYM")
    c = PR.most_frequent_class(t).select(F.col("XH").alias("entity_id"), "CLASS_NAME")
    return s.join(b, "entity_id", "left").join(c, "entity_id", "left")


@query("align_inner", """
SELECT s.entity_id, s.period_key, s.dim_academic, m.kccj_mean AS kccj_mean_raw, m.grade_course_cnt
FROM scored s JOIN mart m USING (entity_id, period_key)""")
def q_align_inner(spark, sf_dir):
    from termlens.operators.marts import materialized_mart
    t = _t(spark, sf_dir)
    s = PR.soft_labels(t).select(*KEYS, "dim_academic")
    m = materialized_mart(t).select(*KEYS, F.col("kccj_mean").alias("kccj_mean_raw"), "grade_course_cnt")
    return s.join(m, KEYS, "inner")


@query("probs_with_raw", """
SELECT s.entity_id, s.period_key, s.mode_id, s.mode_pmax, m.kccj_mean, m.att_present_rate
FROM scored s LEFT JOIN mart m USING (entity_id, period_key)""")
def q_probs_with_raw(spark, sf_dir):
    from termlens.operators.marts import materialized_mart
    t = _t(spark, sf_dir)
    s = PR.soft_labels(t).select(*KEYS, "mode_id", "mode_pmax")
    m = materialized_mart(t).select(*KEYS, "kccj_mean", "att_present_rate")
    return s.join(m, KEYS, "left")


@query("mode_meta_lookup", f"""
SELECT entity_id, period_key, mode_id, {X.mode_name_sql('mode_id')} AS mode_name,
       CASE {' '.join(f"WHEN mode_id = {i} THEN {X.q(C.MODE_DESCRIPTIONS[i])}" for i in range(K))} END AS mode_desc
FROM scored""")
def q_mode_meta_lookup(spark, sf_dir):
    s = _scored(spark, sf_dir).select(*KEYS, "mode_id")
    return s.join(F.broadcast(PR.mode_label_table(spark)), "mode_id", "left").select(*KEYS, "mode_id", "mode_name", "mode_desc")


# ---- group tables ----

_LONG_GROUPS = " UNION ALL ".join(
    f"SELECT '{lv}' AS level, CAST({col} AS VARCHAR) AS group_name, * EXCLUDE ({col}) FROM grp_{lv}"
    for lv, col in C.GROUP_LEVELS.items())


@query("group_profile_modes", _LONG_GROUPS)
def q_group_profile_modes(spark, sf_dir):
    return SV.long_group_table(_profiles(spark, sf_dir))


@query("level_key", f"SELECT level, group_name, period_key, n_records FROM ({_LONG_GROUPS}) WHERE level = 'college'")
def q_level_key(spark, sf_dir):
    g = SV.long_group_table(_profiles(spark, sf_dir))
    return SV.level_rows(g, "college").select("level", "group_name", "period_key", "n_records")


@query("dominant_mode", f"SELECT {GCOL}, period_key, dominant_mode_id, dominant_mode_name FROM grp_{LEVEL}")
def q_dominant_mode(spark, sf_dir):
    return _groups(spark, sf_dir).select(GCOL, "period_key", "dominant_mode_id", "dominant_mode_name")


_CLUSTER_COLS = ", ".join(f"CASE WHEN sum(CASE WHEN mode_id = {i} THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN mode_id = {i} THEN 1 ELSE 0 END) / count(*) END AS cluster_{i}_pct"
                          for i in range(8))
_METRIC_MEANS = ", ".join(f"avg(s.{m}) AS {m}_mean" for m in (
    "kccj_mean", "kccj_fail_rate", "jdcj_mean", "by1_mean", "att_present_rate", "att_absent_rate", "att_event_cnt", "hw_submit_cnt",
    "hw_ungraded_rate", "hw_duration_median", "online_bfb", "sch_amt_sum_term", "comp_cnt_term", "cet_score_max", "fit3_zf_mean"))


@query("group_profile_clusters", " UNION ALL ".join(f"""
SELECT '{level}' AS level, CAST({col} AS VARCHAR) AS group_name, s.period_key, count(*) AS n, {_CLUSTER_COLS}, {_METRIC_MEANS}
FROM scored s LEFT JOIN src_basic_info b ON s.entity_id = b.XH LEFT JOIN class_map c ON s.entity_id = c.XH GROUP BY {col}, s.period_key"""
    for level, col in (("sex", "b.XB"), ("ethnicity", "b.MZMC"), ("politics", "b.ZZMMMC"), ("college", "b.XSM"), ("major", "b.ZYM"), ("class", "c.CLASS_NAME"))))
def q_group_profile_clusters(spark, sf_dir):
    from termlens.sources import bindings as B
    t = _t(spark, sf_dir)
    cls = PR.most_frequent_class(t).select(F.col("XH").alias("entity_id"), "CLASS_NAME")
    attrs = B.basic_info(t).select(F.col("XH").alias("entity_id"), "XB", "MZMC", "ZZMMMC", "XSM", "ZYM").join(cls, "entity_id", "full")
    return PR.level_profile_clusters(PR.soft_labels(t), attrs)


@query("mode_definitions", f"""
SELECT m.mode_id, {X.mode_name_sql('m.mode_id')} AS name,
       CASE {' '.join(f"WHEN m.mode_id = {i} THEN {X.q(C.MODE_DESCRIPTIONS[i])}" for i in range(K))} END AS description,
       coalesce(d.size, 0) AS size, round_even(coalesce(d.pct, 0), 4) AS pct,
       MAP([{', '.join(X.q(d) for d in C.DIM_COLS)}], [{', '.join(f'round_even(coalesce(d.{c}, 0), 4)' for c in C.DIM_COLS)}]) AS dim_profile
FROM (SELECT CAST(range AS INTEGER) AS mode_id FROM range({K})) m
LEFT JOIN (SELECT mode_id, count(*) AS size, count(*) / sum(count(*)) OVER () AS pct,
                  {', '.join(f'avg({c}) AS {c}' for c in C.DIM_COLS)} FROM scored GROUP BY mode_id) d USING (mode_id)""")
def q_mode_definitions(spark, sf_dir):
    return PR.mode_definitions(_scored(spark, sf_dir))


@query("subtype_definitions", f"""
SELECT mode_id, subtype_id, {X.mode_name_sql('mode_id')} AS mode_name, coalesce({X.subtype_name_sql('subtype_id')}, '子类' || CAST(subtype_id AS VARCHAR)) AS name,
       size, round_even(size / sum(size) OVER (PARTITION BY mode_id), 4) AS pct_in_mode
FROM (SELECT mode_id, subtype_id, count(*) AS size FROM scored WHERE subtype_id IS NOT NULL GROUP BY mode_id, subtype_id)""")
def q_subtype_definitions(spark, sf_dir):
    return PR.subtype_definitions(_scored(spark, sf_dir))


@query("share_of_parent", """
SELECT s.mode_id, s.subtype_id, s.size, m.size AS mode_size, s.size / m.size AS pct_in_mode
FROM (SELECT mode_id, subtype_id, count(*) AS size FROM scored WHERE subtype_id IS NOT NULL GROUP BY ALL) s
JOIN (SELECT mode_id, count(*) AS size FROM scored GROUP BY ALL) m USING (mode_id)""")
def q_share_of_parent(spark, sf_dir):
    s = _scored(spark, sf_dir)
    sub = s.where(F.col("subtype_id").isNotNull()).groupBy("mode_id", "subtype_id").agg(F.count(F.lit(1)).alias("size"))
    return sub.select("mode_id", "subtype_id", "size",
                      F.sum("size").over(Window.partitionBy("mode_id")).alias("mode_size"),
                      (F.col("size") / F.sum("size").over(Window.partitionBy("mode_id"))).alias("pct_in_mode"))


@query("mode_profile_dims", f"""
SELECT mode_id, count(*) AS size, count(*) / sum(count(*)) OVER () AS pct, {', '.join(f'avg({c}) AS {c}' for c in C.DIM_COLS)}
FROM scored GROUP BY mode_id""")
def q_mode_profile_dims(spark, sf_dir):
    return PR.mode_profile_dims(_scored(spark, sf_dir))


@query("mode_distribution", "SELECT mode_id, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct FROM scored GROUP BY mode_id")
def q_mode_distribution(spark, sf_dir):
    return PR.mode_distribution(_scored(spark, sf_dir))


@query("weighted_rollup", f"SELECT {GCOL}, " + ", ".join(
    f"sum({c} * coalesce(CAST(n_records AS DOUBLE), 1)) / sum(CASE WHEN {c} IS NOT NULL THEN coalesce(CAST(n_records AS DOUBLE), 1) END) AS {c}"
    for c in X.GROUP_NUMERIC) + f" FROM grp_{LEVEL} GROUP BY {GCOL}")
def q_weighted_rollup(spark, sf_dir):
    return PR.weighted_rollup(_groups(spark, sf_dir), GCOL, PR.group_numeric_cols())


@query("unweighted_rollup", f"SELECT * FROM rollup_{LEVEL}")
def q_unweighted_rollup(spark, sf_dir):
    return PR.unweighted_rollup(_groups(spark, sf_dir), GCOL, PR.group_numeric_cols())


@query("risk_share", f"SELECT {GCOL}, {X.risk_sql()} AS risk FROM rollup_{LEVEL}")
def q_risk_share(spark, sf_dir):
    r = PR.unweighted_rollup(_groups(spark, sf_dir), GCOL, PR.group_numeric_cols())
    return r.select(GCOL, PR.risk_share().alias("risk"))


@query("risk_level", f"SELECT {GCOL}, {X.risk_sql()} AS risk, {X.risk_level_sql(X.risk_sql())} AS risk_level FROM rollup_{LEVEL}")
def q_risk_level(spark, sf_dir):
    r = PR.unweighted_rollup(_groups(spark, sf_dir), GCOL, PR.group_numeric_cols())
    return r.select(GCOL, PR.risk_share().alias("risk"), PR.risk_level(PR.risk_share()).alias("risk_level"))


_BOARD_ORDERS = {
    "risk_desc": ("risk_leaderboard", "risk DESC"),
    "risk_asc": ("risk_leaderboard_asc", "risk ASC"),
    "score_asc": ("risk_leaderboard_score", "CASE WHEN kccj_mean_avg IS NULL OR kccj_mean_avg = 0 THEN 99 ELSE kccj_mean_avg END ASC"),
    "fail_desc": ("risk_leaderboard_fail", "coalesce(kccj_fail_rate_avg, 0) DESC"),
}


def _board(order: str, name: str, by: str):
    @query(name, f"""
SELECT {GCOL} AS group_name, n_records, {X.risk_sql()} AS risk, {X.risk_level_sql(X.risk_sql())} AS risk_level,
       kccj_mean_avg, kccj_fail_rate_avg
FROM rollup_{LEVEL} ORDER BY {by}, group_name ASC LIMIT 100""")
    def q(spark, sf_dir):
        return SV.risk_leaderboard(_groups(spark, sf_dir), GCOL, order=order, limit=100)
    return q


for _order, (_name, _by) in _BOARD_ORDERS.items():
    _board(_order, _name, _by)


@query("risk_bucket_counts", f"""
SELECT count(*) FILTER (WHERE r > {C.RISK_HIGH}) AS n_high, count(*) FILTER (WHERE r > {C.RISK_WATCH} AND r <= {C.RISK_HIGH}) AS n_watch,
       count(*) FILTER (WHERE r <= {C.RISK_WATCH}) AS n_good
FROM (SELECT {X.risk_sql()} AS r FROM rollup_{LEVEL})""")
def q_risk_bucket_counts(spark, sf_dir):
    return SV.risk_bucket_counts(_groups(spark, sf_dir), GCOL)


@query("overall_shares", f"""
SELECT sum(CASE WHEN mode_id IN (1, 6) THEN pct ELSE 0 END) AS risk_pct, sum(CASE WHEN mode_id IN (2, 3) THEN pct ELSE 0 END) AS strong_pct
FROM (SELECT mode_id, count(*) / sum(count(*)) OVER () AS pct FROM scored GROUP BY mode_id)""")
def q_overall_shares(spark, sf_dir):
    return SV.overall_shares(PR.mode_distribution(_scored(spark, sf_dir)))


@query("est_mode_size", f"SELECT {GCOL}, " + ", ".join(
    f"CAST(floor(mode_{i}_pct * n_records + 0.5) AS BIGINT) AS mode_{i}_n" for i in range(K)) + f" FROM rollup_{LEVEL}")
def q_est_mode_size(spark, sf_dir):
    r = PR.unweighted_rollup(_groups(spark, sf_dir), GCOL, PR.group_numeric_cols())
    return r.select(GCOL, *[SV.est_mode_size(f"mode_{i}_pct", "n_records").alias(f"mode_{i}_n") for i in range(K)])


# ---- lookups, filters, picklists ----

ENTITY = "7"
PERIOD = "1997-1998-1"
GROUP = "GERMANY"
SEARCH = "ger"


@query("entity_lookup", f"SELECT * FROM profiles WHERE entity_id = '{ENTITY}' ORDER BY period_key")
def q_entity_lookup(spark, sf_dir):
    return SV.entity_lookup(_profiles(spark, sf_dir), ENTITY)


@query("group_filter", f"SELECT * FROM grp_{LEVEL} WHERE {GCOL} = '{GROUP}' AND period_key = '{PERIOD}'")
def q_group_filter(spark, sf_dir):
    return SV.group_filter(_groups(spark, sf_dir), GCOL, GROUP, PERIOD)


@query("name_search", f"SELECT {GCOL}, n_records FROM rollup_{LEVEL} WHERE contains(lower({GCOL}), '{SEARCH}')")
def q_name_search(spark, sf_dir):
    r = PR.unweighted_rollup(_groups(spark, sf_dir), GCOL, PR.group_numeric_cols())
    return SV.name_search(r, GCOL, SEARCH).select(GCOL, "n_records")


@query("drop_blank_groups", f"SELECT {GCOL}, count(*) AS n FROM profiles WHERE {GCOL} IS NOT NULL AND trim({GCOL}) NOT IN ('', 'nan', 'None') GROUP BY 1")
def q_drop_blank_groups(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    return p.where(PR.drop_blank_groups(GCOL)).groupBy(GCOL).agg(F.count(F.lit(1)).alias("n"))


@query("distinct_picklist", f"""
SELECT 'group' AS kind, {GCOL} AS value FROM (SELECT DISTINCT {GCOL} FROM grp_{LEVEL}) WHERE {GCOL} IS NOT NULL AND {GCOL} <> ''
UNION ALL SELECT 'period', period_key FROM (SELECT DISTINCT period_key FROM grp_{LEVEL}) WHERE period_key IS NOT NULL AND period_key <> ''""")
def q_distinct_picklist(spark, sf_dir):
    return SV.distinct_picklist(_groups(spark, sf_dir), GCOL)


@query("kpi_counts", "SELECT count(*) AS n_rows, count(DISTINCT subtype_id) AS n_subtypes, count(DISTINCT entity_id) AS n_entities FROM scored")
def q_kpi_counts(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("subtype_id").alias("n_subtypes"),
                 F.countDistinct("entity_id").alias("n_entities"))


@query("entity_overall", "SELECT entity_id, count(*) AS n_periods, " + ", ".join(
    f"avg({c}) AS {c}" for c in P_COLS + C.DIM_COLS) + " FROM scored GROUP BY entity_id")
def q_entity_overall(spark, sf_dir):
    return SV.entity_overall(_scored(spark, sf_dir), P_COLS + C.DIM_COLS)


@query("top3_modes_row", """
SELECT entity_id, period_key, t.i AS mode_id, -t.np AS p, r AS rank FROM (
  SELECT entity_id, period_key, unnest(list_slice(list_sort(list_transform(
      [p_mode_0, p_mode_1, p_mode_2, p_mode_3, p_mode_4, p_mode_5, p_mode_6, p_mode_7],
      lambda x, i: {'np': -x, 'i': i - 1})), 1, 3)) AS t, unnest([1, 2, 3]) AS r FROM scored)""")
def q_top3_modes_row(spark, sf_dir):
    return SV.top3_modes_row(_scored(spark, sf_dir), P_COLS)


@query("top3_modes_entity", """
SELECT entity_id, mode_id, p, rank FROM (
  SELECT entity_id, mode_id, p, row_number() OVER (PARTITION BY entity_id ORDER BY p DESC, mode_id) AS rank FROM (
    SELECT entity_id, CAST(m AS INTEGER) AS mode_id, avg(CASE m """ + " ".join(
    f"WHEN {i} THEN p_mode_{i}" for i in range(K)) + """ END) AS p
    FROM scored, range(8) r(m) GROUP BY entity_id, m))
WHERE rank <= 3""")
def q_top3_modes_entity(spark, sf_dir):
    return SV.top3_modes_entity(_scored(spark, sf_dir), P_COLS)


@query("latest_period", """
SELECT entity_id, period_key, mode_id, mode_pmax FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period_key DESC) AS rn FROM scored) WHERE rn = 1""")
def q_latest_period(spark, sf_dir):
    return SV.latest_period(_scored(spark, sf_dir)).select(*KEYS, "mode_id", "mode_pmax")


@query("period_series", f"""
SELECT period_key, metric, value FROM (
  UNPIVOT (SELECT period_key, {', '.join(f'mode_{i}_pct * 100 AS mode_{i}_pct' for i in range(K))}, kccj_mean_avg,
                  {', '.join(f'{d}_mean' for d in C.DIM_COLS)}
           FROM grp_{LEVEL} WHERE {GCOL} = '{GROUP}')
  ON COLUMNS(* EXCLUDE (period_key)) INTO NAME metric VALUE value)""")
def q_period_series(spark, sf_dir):
    return SV.period_series(_groups(spark, sf_dir), GCOL, GROUP, "kccj_mean_avg")


@query("row_search", f"""
SELECT {GCOL}, period_key, n_records FROM grp_{LEVEL} g
WHERE contains(lower(CAST(to_json(g) AS VARCHAR)), '{SEARCH}') AND period_key = '{PERIOD}'""")
def q_row_search(spark, sf_dir):
    return SV.row_search(_groups(spark, sf_dir), None, SEARCH, PERIOD, order=[GCOL, "period_key"]).select(
        GCOL, "period_key", "n_records")


@query("class_rows_nonempty", "SELECT count(*) AS n FROM class_votes")
def q_class_rows_nonempty(spark, sf_dir):
    t = _t(spark, sf_dir)
    from termlens.sources import bindings as B
    hw = B.homework(t).select(F.col("CREATER_LOGIN_NAME").alias("XH"), F.col("CLASS_ID").alias("cid"), F.col("CLASS_NAME").alias("cname"))
    si = B.signin(t).select(F.col("LOGIN_NAME").alias("XH"), F.col("CLASSID").alias("cid"), F.col("CLASSNAME").alias("cname"))
    u = SV.class_rows_nonempty(hw.unionByName(si), "cid", "cname").where(F.col("XH").isNotNull())
    return u.groupBy("XH", "cid", "cname").count().agg(F.count(F.lit(1)).alias("n"))


# ---- rankings ----

@query("top_n_groups", f"""
SELECT * FROM (SELECT {GCOL}, n_records FROM rollup_{LEVEL} ORDER BY n_records DESC, {GCOL} LIMIT 25)""")
def q_top_n_groups(spark, sf_dir):
    r = PR.unweighted_rollup(_groups(spark, sf_dir), GCOL, PR.group_numeric_cols())
    return SV.top_n(r, [F.desc("n_records"), F.asc(GCOL)], 25).select(GCOL, "n_records")


@query("mode_cards", "SELECT mode_id, n, pct FROM (SELECT mode_id, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct "
       "FROM scored GROUP BY mode_id) ORDER BY n DESC, mode_id LIMIT 8")
def q_mode_cards(spark, sf_dir):
    d = PR.mode_distribution(_scored(spark, sf_dir))
    return SV.top_n(d, [F.desc("n"), F.asc("mode_id")], 8)


@query("risk_score_scatter", f"""
SELECT {GCOL}, round_even(coalesce(kccj_mean_avg, 0), 1) AS score, round_even(({X.risk_sql()}) * 100, 1) AS risk_pct,
       {X.risk_level_sql(X.risk_sql())} AS bucket
FROM rollup_{LEVEL}""")
def q_risk_score_scatter(spark, sf_dir):
    r = PR.unweighted_rollup(_groups(spark, sf_dir), GCOL, PR.group_numeric_cols())
    return r.select(GCOL, np_round(F.coalesce(F.col("kccj_mean_avg"), F.lit(0.0)), 1).alias("score"), np_round(PR.risk_share() * 100, 1).alias("risk_pct"),
                    PR.risk_level(PR.risk_share()).alias("bucket"))


@query("short_period", f"""
SELECT period_key, regexp_replace(period_key, '^\\d{{3}}(\\d)-\\d{{3}}(\\d)-(\\d)$', '\\1-\\2-\\3') AS short_key, count(*) AS n
FROM scored GROUP BY period_key""")
def q_short_period(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.groupBy("period_key").agg(F.count(F.lit(1)).alias("n")).select(
        "period_key", SV.short_period("period_key").alias("short_key"), "n")


@query("safe_rel_change", """
SELECT entity_id, period_key,
       (kccj_median - kccj_mean) / CASE WHEN abs(kccj_mean) > 1e-12 THEN abs(kccj_mean) ELSE 1.0 END AS rel_change
FROM mart""")
def q_safe_rel_change(spark, sf_dir):
    from termlens.operators.marts import materialized_mart
    m = materialized_mart(_t(spark, sf_dir))
    return m.select(*KEYS, SV.safe_rel_change("kccj_mean", "kccj_median").alias("rel_change"))
