"""Registered queries: period keys, mart blocks and the assembled mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from termlens.functions import keys as K
from termlens.operators import marts as M
from termlens.plans.registry import query
from termlens.plans.sql_bindings import CTES, MART_COLUMNS, period, year_term, ym_term
from termlens.sources import bindings as B
from termlens.sources.tables import Tables


def _ren(df):
    return df.withColumnRenamed("XH", "entity_id").withColumnRenamed("TERM_KEY", "period_key")


def mart(spark, sf_dir):
    return M.build_feature_mart(Tables(spark, sf_dir))


# ---- period keys ----

@query("term_from_code", """
SELECT ZXJXJHH AS raw, CASE WHEN trim(ZXJXJHH) = '' OR lower(trim(ZXJXJHH)) = 'nan' THEN NULL ELSE trim(ZXJXJHH) END
       AS period_key, count(*) AS n
FROM src_grades GROUP BY ALL""")
def q_term_from_code(spark, sf_dir):
    g = B.grades(Tables(spark, sf_dir))
    return g.groupBy(F.col("ZXJXJHH").alias("raw"), K.term_from_code("ZXJXJHH").alias("period_key")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("term_from_text", """
SELECT XQ AS raw, TERM_KEY AS period_key, count(*) AS n FROM (
  SELECT XQ, CASE WHEN regexp_extract(XQ, '(\\d{4})\\s*-\\s*(\\d{4}).*?第\\s*([12])\\s*学期', 1) <> ''
         THEN regexp_extract(XQ, '(\\d{4})\\s*-\\s*(\\d{4}).*?第\\s*([12])\\s*学期', 1) || '-' ||
              regexp_extract(XQ, '(\\d{4})\\s*-\\s*(\\d{4}).*?第\\s*([12])\\s*学期', 2) || '-' ||
              regexp_extract(XQ, '(\\d{4})\\s*-\\s*(\\d{4}).*?第\\s*([12])\\s*学期', 3) END AS TERM_KEY
  FROM src_fitness_term) GROUP BY ALL""")
def q_term_from_text(spark, sf_dir):
    f = B.fitness_term(Tables(spark, sf_dir))
    return f.groupBy(F.col("XQ").alias("raw"), K.term_from_text("XQ").alias("period_key")).agg(F.count(F.lit(1)).alias("n"))


@query("term_from_year", f"""
SELECT TCNF AS raw, {year_term('TCNF')} AS period_key, count(*) AS n FROM src_fitness_year GROUP BY ALL""")
def q_term_from_year(spark, sf_dir):
    f = B.fitness_year(Tables(spark, sf_dir))
    return f.groupBy(F.col("TCNF").alias("raw"), K.term_from_year("TCNF").alias("period_key")).agg(F.count(F.lit(1)).alias("n"))


@query("term_from_year_month", f"""
SELECT PDXN AS year_raw, PDXQ AS month_raw, {ym_term('PDXN', 'PDXQ')} AS period_key, count(*) AS n
FROM src_assessment GROUP BY ALL""")
def q_term_from_year_month(spark, sf_dir):
    z = B.assessment(Tables(spark, sf_dir))
    return z.groupBy(F.col("PDXN").alias("year_raw"), F.col("PDXQ").alias("month_raw"),
                     K.term_from_year_month("PDXN", "PDXQ").alias("period_key")).agg(F.count(F.lit(1)).alias("n"))


@query("term_from_date", f"""
SELECT strftime(HJSJ_PARSED, '%Y-%m-%d') AS day, {period('HJSJ_PARSED')} AS period_key, count(*) AS n
FROM src_contests GROUP BY ALL""")
def q_term_from_date(spark, sf_dir):
    c = B.contests(Tables(spark, sf_dir))
    return c.groupBy(F.date_format("HJSJ_PARSED", "yyyy-MM-dd").alias("day"), K.term_from_date("HJSJ_PARSED").alias("period_key")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("duration_fix", """
SELECT CASE WHEN DUR_FIXED < 0 THEN 'negative' WHEN DUR_FIXED >= 3600 THEN 'over_hour' ELSE 'ok' END AS bucket,
       count(*) AS n, sum(DUR_FIXED) AS total_sec, min(DUR_FIXED) AS min_sec, max(DUR_FIXED) AS max_sec
FROM hw_rows GROUP BY 1""")
def q_duration_fix(spark, sf_dir):
    h = B.homework(Tables(spark, sf_dir))
    d = h.select(K.duration_fix("CREATER_TIME", "ANSWER_TIME", "ANSWER_DURATION_SEC").alias("d"))
    b = F.when(F.col("d") < 0, "negative").when(F.col("d") >= 3600, "over_hour").otherwise("ok")
    return d.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total_sec"),
                                            F.min("d").alias("min_sec"), F.max("d").alias("max_sec"))


@query("to_number", """
SELECT count(*) AS n, count(TRY_CAST(PDXQ AS DOUBLE)) AS n_parsed, sum(TRY_CAST(PDXQ AS DOUBLE)) AS total
FROM src_assessment""")
def q_to_number(spark, sf_dir):
    from termlens.functions.nulls import to_number
    z = B.assessment(Tables(spark, sf_dir))
    return z.agg(F.count(F.lit(1)).alias("n"), F.count(to_number("PDXQ")).alias("n_parsed"),
                 F.sum(to_number("PDXQ")).alias("total"))


@query("require_keys", """
SELECT count(*) AS n_in, count(*) FILTER (WHERE XH IS NOT NULL AND TERM_KEY IS NOT NULL) AS n_kept
FROM (SELECT XH, CASE WHEN trim(ZXJXJHH) = '' OR lower(trim(ZXJXJHH)) = 'nan' THEN NULL ELSE trim(ZXJXJHH) END AS TERM_KEY
      FROM src_grades)""")
def q_require_keys(spark, sf_dir):
    g = B.grades(Tables(spark, sf_dir)).select("XH", K.term_from_code("ZXJXJHH").alias("TERM_KEY"))
    return g.agg(F.count(F.lit(1)).alias("n_in"),
                 F.count_if(F.col("XH").isNotNull() & F.col("TERM_KEY").isNotNull()).alias("n_kept"))


# ---- mart blocks ----

@query("score_features", "SELECT XH AS entity_id, TERM_KEY AS period_key, * EXCLUDE (XH, TERM_KEY) FROM blk_grade")
def q_score_features(spark, sf_dir):
    return _ren(M.score_features(B.grades(Tables(spark, sf_dir))))


@query("fail_rate", "SELECT XH AS entity_id, TERM_KEY AS period_key, kccj_fail_rate FROM blk_grade")
def q_fail_rate(spark, sf_dir):
    g = B.grades(Tables(spark, sf_dir)).select(F.col("XH"), K.term_from_code("ZXJXJHH").alias("TERM_KEY"), "KCCJ")
    return _ren(g.dropna(subset=["XH", "TERM_KEY"]).groupBy("XH", "TERM_KEY").agg(M.fail_rate("KCCJ").alias("kccj_fail_rate")))


@query("online_features", "SELECT XH AS entity_id, online_bfb FROM blk_online")
def q_online(spark, sf_dir):
    return _ren(M.online_features(B.online(Tables(spark, sf_dir))))


@query("fitness_term_features", "SELECT XH AS entity_id, TERM_KEY AS period_key, * EXCLUDE (XH, TERM_KEY) FROM blk_fit_term")
def q_fit_term(spark, sf_dir):
    return _ren(M.fitness_term_features(B.fitness_term(Tables(spark, sf_dir))))


@query("fitness_year_features", "SELECT XH AS entity_id, TERM_KEY AS period_key, * EXCLUDE (XH, TERM_KEY) FROM blk_fit_year")
def q_fit_year(spark, sf_dir):
    return _ren(M.fitness_year_features(B.fitness_year(Tables(spark, sf_dir))))


@query("assessment_features", """
SELECT e.XH AS entity_id, t.TERM_KEY AS period_key, t.zc_zf_mean, t.zc_bjpm_mean_term, t.zc_zypm_mean_term,
       e.zc_records, e.zc_bjpm_best, e.zc_bjpm_mean, e.zc_zypm_best, e.zc_zypm_mean
FROM blk_zc_entity e LEFT JOIN blk_zc_term t ON e.XH = t.XH""")
def q_assessment(spark, sf_dir):
    term, ent = M.assessment_features(B.assessment(Tables(spark, sf_dir)))
    return _ren(ent.join(term, "XH", "left").select("XH", "TERM_KEY", "zc_zf_mean", "zc_bjpm_mean_term",
                                                     "zc_zypm_mean_term", "zc_records", "zc_bjpm_best", "zc_bjpm_mean",
                                                     "zc_zypm_best", "zc_zypm_mean"))


@query("award_features", """
SELECT e.XH AS entity_id, t.TERM_KEY AS period_key, e.sch_cnt, e.sch_amt_sum, t.sch_cnt_term, t.sch_amt_sum_term
FROM blk_sch_entity e LEFT JOIN blk_sch_term t ON e.XH = t.XH""")
def q_award(spark, sf_dir):
    ent, term = M.award_features(B.awards(Tables(spark, sf_dir)))
    return _ren(ent.join(term, "XH", "left"))


@query("exam_features", "SELECT XH AS entity_id, cet_score_max, cet_level_max FROM blk_cet")
def q_exam(spark, sf_dir):
    return _ren(M.exam_features(B.language_exam(Tables(spark, sf_dir))))


@query("contest_features", """
SELECT e.XH AS entity_id, t.TERM_KEY AS period_key, e.comp_cnt, t.comp_cnt_term
FROM blk_comp_entity e LEFT JOIN blk_comp_term t ON e.XH = t.XH""")
def q_contest(spark, sf_dir):
    ent, term = M.contest_features(B.contests(Tables(spark, sf_dir)))
    return _ren(ent.join(term, "XH", "left"))


@query("status_change_features", "SELECT XH AS entity_id, TERM_KEY AS period_key, yd_cnt, yd_type_nunique FROM blk_yd")
def q_status(spark, sf_dir):
    return _ren(M.status_change_features(B.status_changes(Tables(spark, sf_dir))))


@query("homework_features", "SELECT XH AS entity_id, hw_submit_cnt, hw_ungraded_rate, hw_duration_median FROM blk_hw")
def q_homework(spark, sf_dir):
    return _ren(M.homework_features(B.homework(Tables(spark, sf_dir))))


@query("attendance_features", "SELECT XH AS entity_id, * EXCLUDE (XH) FROM blk_att")
def q_attendance(spark, sf_dir):
    return _ren(M.attendance_features(B.signin(Tables(spark, sf_dir))))


@query("status_indicators", """
SELECT ACTIVE_STATE AS state, count(*) AS n,
       sum(coalesce(CAST(ACTIVE_STATE = 1 AS DOUBLE), 0)) AS present,
       sum(coalesce(CAST(ACTIVE_STATE = 5 AS DOUBLE), 0)) AS absent,
       sum(coalesce(CAST(ACTIVE_STATE NOT IN (0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12) AND ACTIVE_STATE IS NOT NULL AS DOUBLE), 0))
         AS abnormal
FROM src_signin GROUP BY 1""")
def q_status_indicators(spark, sf_dir):
    s = B.signin(Tables(spark, sf_dir))
    p, a, ab = M.status_indicators("ACTIVE_STATE")
    return s.groupBy(F.col("ACTIVE_STATE").alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("present"), F.sum(a).alias("absent"), F.sum(ab).alias("abnormal"))


@query("build_feature_mart", "SELECT * FROM mart")
def q_build_feature_mart(spark, sf_dir):
    return mart(spark, sf_dir)


@query("mart_left_join_period", """
SELECT g.XH AS entity_id, g.TERM_KEY AS period_key, g.kccj_mean, f.fit3_zf_mean, f.fit3_fhl_mean
FROM blk_grade g LEFT JOIN blk_fit_year f USING (XH, TERM_KEY)""")
def q_join_period(spark, sf_dir):
    t = Tables(spark, sf_dir)
    g = M.score_features(B.grades(t)).select("XH", "TERM_KEY", "kccj_mean")
    f = M.fitness_year_features(B.fitness_year(t)).select("XH", "TERM_KEY", "fit3_zf_mean", "fit3_fhl_mean")
    return _ren(g.join(f, ["XH", "TERM_KEY"], "left"))


@query("mart_left_join_entity", """
SELECT g.XH AS entity_id, g.TERM_KEY AS period_key, g.kccj_mean, a.att_event_cnt, a.att_present_rate
FROM blk_grade g LEFT JOIN blk_att a USING (XH)""")
def q_join_entity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    g = M.score_features(B.grades(t)).select("XH", "TERM_KEY", "kccj_mean")
    a = M.attendance_features(B.signin(t)).select("XH", "att_event_cnt", "att_present_rate")
    return _ren(g.join(a, "XH", "left"))


@query("canonical_key", """
SELECT LOGIN_NAME AS entity_id, count(*) AS n FROM src_signin GROUP BY 1""")
def q_canonical_key(spark, sf_dir):
    s = B.signin(Tables(spark, sf_dir)).withColumnRenamed("LOGIN_NAME", "entity_id")
    return s.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


assert MART_COLUMNS == M.MART_COLUMNS
assert "mart" in CTES
