"""Registered queries: sources and sinks (S1-S3, S7-S9, S11-S13), table overview (A14), period-key quality
and the event-window features (A11 / A12 by window, the streaming operators' batch twin).

File round-trips write Spark-derived copies of the driver tables under the shared checkpoint folder and read
them back, so each query still scales with the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from termlens import config as C
from termlens.functions import keys as KY
from termlens.operators import quality as QL
from termlens.functions.nulls import is_missing_value
from termlens.operators.marts import MART_COLUMNS, build_feature_mart, materialized_mart
from termlens.plans.registry import query
from termlens.sources import bindings as B
from termlens.sources import files as FS
from termlens.sources.tables import Tables
from termlens.streaming import events as EV

BASIC_COLS = ["XH", "XB", "MZMC", "ZZMMMC", "XSM", "ZYM"]


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


@query("scan_table", "SELECT " + ", ".join(BASIC_COLS) + " FROM src_basic_info")
def q_scan_table(spark, sf_dir):
    p = FS.write_csv(B.basic_info(_t(spark, sf_dir)), FS.scratch_path(spark, "basic-csv"))
    return FS.scan_table(spark, p, BASIC_COLS)


@query("scan_encoding_fallback")
def q_scan_encoding_fallback(spark, sf_dir):
    """A GBK-encoded copy is detected by the replacement character in its header and re-read as GBK."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = B.fitness_term(_t(spark, sf_dir)).select(F.col("XH").alias("学号"), F.col("XQ").alias("学期"))
    p = FS.write_csv(df, FS.scratch_path(spark, "gbk-csv"), encoding="GBK")
    back, enc = FS.scan_encoding_fallback(spark, p, ["学号", "学期"])
    return back.groupBy(F.lit(enc).alias("encoding_used"), "学期").agg(F.count(F.lit(1)).alias("n"))


@query("scan_directory", """
SELECT 'signin' AS folder, count(*) AS n FROM src_signin UNION ALL SELECT 'online', count(*) FROM src_online""")
def q_scan_directory(spark, sf_dir):
    t = _t(spark, sf_dir)
    root = FS.scratch_path(spark, "dir")
    FS.write_csv(B.signin(t).select("LOGIN_NAME", "ACTIVE_STATE"), f"{root}/signin")
    FS.write_csv(B.online(t).select("LOGIN_NAME", "BFB"), f"{root}/online")
    df = FS.scan_directory(spark, root, "*.csv")
    folder = F.regexp_extract("source_file", r"/([^/]+)/[^/]+$", 1)
    return df.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("convert_files", """
SELECT 'signin' AS dataset, true AS ok, count(*) AS rows, 'UTF-8' AS encoding, 'converted' AS message FROM src_signin
UNION ALL SELECT 'online', true, count(*), 'UTF-8', 'converted' FROM src_online""")
def q_convert_files(spark, sf_dir):
    t = _t(spark, sf_dir)
    src = FS.scratch_path(spark, "convert-src")
    FS.write_csv(B.signin(t).select("LOGIN_NAME", "ACTIVE_STATE"), f"{src}/signin")
    FS.write_csv(B.online(t).select("LOGIN_NAME", "BFB"), f"{src}/online")
    st = FS.convert_files(spark, src, FS.scratch_path(spark, "convert-dst"))
    return st.groupBy("dataset").agg(F.min("ok").alias("ok"), F.sum("rows").alias("rows"), F.max("encoding").alias("encoding"), F.max("message").alias("message"))


@query("sink_table", "SELECT period_key, count(*) AS n, sum(grade_course_cnt) AS courses FROM mart GROUP BY period_key")
def q_sink_table(spark, sf_dir):
    p = FS.sink_table(build_feature_mart(_t(spark, sf_dir)), FS.scratch_path(spark, "mart"), ["period_key"])
    back = spark.read.parquet(p)
    return back.groupBy("period_key").agg(F.count(F.lit(1)).alias("n"), F.sum("grade_course_cnt").alias("courses"))


@query("sink_json_docs", "SELECT mode_id, count(*) AS size FROM scored GROUP BY mode_id")
def q_sink_json_docs(spark, sf_dir):
    from termlens.operators.profiles import mode_definitions, soft_labels
    d = mode_definitions(soft_labels(_t(spark, sf_dir)))
    p = FS.sink_json_docs(d, FS.scratch_path(spark, "modes-json"))
    back = spark.read.schema("mode_id int, name string, size long, dim_profile map<string,double>").json(p)
    return back.where(F.col("size") > 0).select("mode_id", "size")


@query("snapshot", f"SELECT count(*) AS n_rows, {len(MART_COLUMNS) + 2} AS n_cols FROM mart")
def q_snapshot(spark, sf_dir):
    m = materialized_mart(_t(spark, sf_dir))
    snap = FS.snapshot(m, FS.scratch_path(spark, "frozen"), "1", expect_rows=m.count())
    return snap.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(snap.columns)).alias("n_cols"))


@query("load_serving_tables", """
SELECT 'group_major' AS name, true AS loaded, count(*) AS rows FROM grp_major
UNION ALL SELECT 'group_class', false, NULL""")
def q_load_serving_tables(spark, sf_dir):
    from termlens.operators.profiles import entity_profiles, group_profile_modes
    root = FS.scratch_path(spark, "serving")
    g = group_profile_modes(entity_profiles(_t(spark, sf_dir)), C.GROUP_LEVELS["major"])
    FS.sink_table(g, f"{root}/group_major")
    tabs = FS.load_serving_tables(spark, root, ["group_major", "group_class"])
    rows = [(n, df is not None, df.count() if df is not None else None) for n, df in tabs.items()]
    return spark.createDataFrame(rows, "name string, loaded boolean, rows long")


@query("auto_number", """
SELECT src, count(num) AS n_num, count(txt) AS n_text, count(*) - count(num) - count(txt) AS n_null, sum(num) AS total FROM (
  SELECT 'props_k' AS src, TRY_CAST(nullif(trim(json_extract_string(props, '$.k')), '') AS DOUBLE) AS num,
         CASE WHEN TRY_CAST(nullif(trim(json_extract_string(props, '$.k')), '') AS DOUBLE) IS NULL THEN nullif(trim(json_extract_string(props, '$.k')), '') END AS txt
  FROM events
  UNION ALL SELECT 'event_type', TRY_CAST(event_type AS DOUBLE),
         CASE WHEN TRY_CAST(event_type AS DOUBLE) IS NULL AND trim(event_type) <> '' AND lower(trim(event_type)) <> 'nan' THEN trim(event_type) END
  FROM events) GROUP BY src""")
def q_auto_number(spark, sf_dir):
    e = _t(spark, sf_dir).events
    u = e.select(F.lit("props_k").alias("src"), FS.auto_number(F.get_json_object("props", "$.k")).alias("v")) \
        .unionByName(e.select(F.lit("event_type").alias("src"), FS.auto_number("event_type").alias("v")))
    return u.groupBy("src").agg(F.count("v.num").alias("n_num"), F.count("v.text").alias("n_text"),
                                (F.count(F.lit(1)) - F.count("v.num") - F.count("v.text")).alias("n_null"),
                                F.sum("v.num").alias("total"))


# ---- A14 table overview over the reference-shaped source tables ----

# Columns of the bound tables that identify an entity, first match wins, and those whose missing rate is reported.
ID_GUESS = ["XH", "LOGIN_NAME", "CREATER_LOGIN_NAME", "XSBH", "KS_XH"]
KEY_CHECK = ["XH", "LOGIN_NAME", "CREATER_LOGIN_NAME", "BFB", "KCCJ", "JDCJ", "SJCJ", "HSCJ", "ACTIVE_STATE"]
SOURCES = ["grades", "signin", "homework", "online", "fitness_term", "fitness_year", "assessment", "awards",
           "language_exam", "contests", "status_changes", "basic_info"]


def _overview_parts(t):
    out = []
    for name in SOURCES:
        df = getattr(B, name)(t)
        cols = df.columns
        idc = next((c for c in ID_GUESS if c in cols), None)
        keys = sorted(set(([idc] if idc else []) + [c for c in KEY_CHECK if c in cols]))
        out.append((name, df, cols, idc, keys))
    return out


def _overview_sql():
    from termlens.sources.tables import Tables as _T  # noqa: F401
    parts = []
    # column lists are static (same bindings), so the SQL is generated from the Spark-side schema names
    static = {
        "grades": ["XH", "ZXJXJHH", "KCCJ", "JDCJ", "BY1"],
        "signin": ["LOGIN_NAME", "ACTIVE_STATE", "CLASSID", "CLASSNAME"],
        "homework": ["CREATER_LOGIN_NAME", "IS_UNGRADED", "ANSWER_DURATION_SEC", "CREATER_TIME", "ANSWER_TIME", "CLASS_ID", "CLASS_NAME"],
        "online": ["LOGIN_NAME", "BFB"], "fitness_term": ["XH", "XQ", "SJCJ", "HSCJ"],
        "fitness_year": ["XH", "TCNF", "ZF", "FHL", "WS", "LDTY", "ZWTQQ"],
        "assessment": ["XH", "PDXN", "PDXQ", "ZF", "BJPM", "ZYPM"], "awards": ["XSBH", "PDXN", "FFJE"],
        "language_exam": ["KS_XH", "KS_CJ", "KS_YYJB"], "contests": ["XHHGH", "HJSJ_PARSED"],
        "status_changes": ["XH", "BY1_parsed", "YDLBDM"], "basic_info": ["XH", "XB", "MZMC", "ZZMMMC", "XSM", "ZYM"],
    }
    for name in SOURCES:
        cols = static[name]
        idc = next((c for c in ID_GUESS if c in cols), None)
        keys = sorted(set(([idc] if idc else []) + [c for c in KEY_CHECK if c in cols]))
        miss = lambda c: f"({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' OR lower(trim(CAST({c} AS VARCHAR))) = 'nan')"
        id_miss = f"avg(CASE WHEN {miss(idc)} THEN 1.0 ELSE 0.0 END)" if idc else "NULL"
        id_dist = f"count(DISTINCT CASE WHEN NOT {miss(idc)} THEN trim(CAST({idc} AS VARCHAR)) END)" if idc else "0"
        key_miss = "greatest(" + ", ".join(f"avg(CASE WHEN {miss(k)} THEN 1.0 ELSE 0.0 END)" for k in keys) + ")" if keys else "NULL"
        parts.append(f"SELECT '{name}' AS table_name, count(*) AS n_rows, {len(cols)} AS n_cols, '{idc or ''}' AS id_col_guess, "
                     f"CAST({id_miss} AS DOUBLE) AS id_missing_rate, CAST({id_dist} AS BIGINT) AS id_distinct, "
                     f"'{','.join(keys)}' AS key_cols_checked, CAST({key_miss} AS DOUBLE) AS max_key_missing_rate FROM src_{name}")
    return " UNION ALL ".join(parts)


@query("table_overview", _overview_sql())
def q_table_overview(spark, sf_dir):
    """Per source table rows, columns, id column guess, id missing rate, exact distinct ids (no cap), the key
    columns checked and their largest missing rate — one aggregate per table, unioned."""
    out = None
    for name, df, cols, idc, keys in _overview_parts(_t(spark, sf_dir)):
        miss = lambda c: is_missing_value(c)
        aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).alias("n_cols"), F.lit(idc or "").alias("id_col_guess"),
                (F.avg(miss(idc).cast("double")) if idc else F.lit(None).cast("double")).alias("id_missing_rate"),
                (F.countDistinct(F.when(~miss(idc), F.trim(F.col(idc).cast("string")))) if idc else F.lit(0).cast("long"))
                .alias("id_distinct"),
                F.lit(",".join(keys)).alias("key_cols_checked"),
                (F.greatest(*[F.avg(miss(k).cast("double")) for k in keys]) if len(keys) > 1 else
                 (F.avg(miss(keys[0]).cast("double")) if keys else F.lit(None).cast("double"))).alias("max_key_missing_rate")]
        r = df.agg(*aggs).select(F.lit(name).alias("table_name"), "*")
        out = r if out is None else out.unionByName(r)
    return out


# ---- A39 period-key quality ----

@query("period_key_quality", """
WITH k AS (
  SELECT 'grade_code' AS source, XH AS entity, [CAST(KCCJ AS DOUBLE), CAST(JDCJ AS DOUBLE), CAST(BY1 AS DOUBLE)] AS event,
         CASE WHEN trim(ZXJXJHH) = '' OR lower(trim(ZXJXJHH)) = 'nan' THEN NULL ELSE trim(ZXJXJHH) END AS pk FROM src_grades
  UNION ALL SELECT 'contest_date', XHHGH, [CAST(epoch(CAST(HJSJ_PARSED AS TIMESTAMP)) AS DOUBLE)], """ + "(CAST(year(HJSJ_PARSED) AS VARCHAR) || '-' || CAST(year(HJSJ_PARSED) + 1 AS VARCHAR) || '-' || CASE WHEN month(HJSJ_PARSED) >= 8 THEN '1' ELSE '2' END)" + """ FROM src_contests
  UNION ALL SELECT 'award_year', XSBH, [CAST(FFJE AS DOUBLE)], CAST(TRY_CAST(TRY_CAST(PDXN AS DOUBLE) AS INTEGER) AS VARCHAR) || '-' || CAST(TRY_CAST(TRY_CAST(PDXN AS DOUBLE) AS INTEGER) + 1 AS VARCHAR) || '-2' FROM src_awards),
c AS (SELECT source, count(*) AS n_events, count(*) FILTER (WHERE keys > 1) AS conflicting_events
      FROM (SELECT source, entity, event, count(DISTINCT pk) AS keys FROM k GROUP BY source, entity, event) GROUP BY source)
SELECT source, avg(CASE WHEN pk IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage, count(DISTINCT pk) AS n_keys,
       avg(CASE WHEN regexp_matches(pk, '^\\d{4}-\\d{4}-[12]$') THEN 1.0 ELSE 0.0 END) AS format_ok_rate,
       avg(CASE WHEN pk IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8 AS meets_target, any_value(n_events) AS n_events, any_value(conflicting_events) AS conflicting_events
FROM k JOIN c USING (source) GROUP BY source""")
def q_period_key_quality(spark, sf_dir):
    """A39 over the three key sources; an event is what the record itself says (marks, date, amount)."""
    t = _t(spark, sf_dir)

    def part(df, source, entity, event, key):
        return df.select(F.lit(source).alias("source"), F.col(entity).alias("entity"), F.array(*[c.cast("double") for c in event]).alias("event"), key.alias("pk"))

    k = part(B.grades(t), "grade_code", "XH", [F.col(c) for c in ("KCCJ", "JDCJ", "BY1")], KY.term_from_code("ZXJXJHH")) \
        .unionByName(part(B.contests(t), "contest_date", "XHHGH", [F.col("HJSJ_PARSED").cast("timestamp")], KY.term_from_date("HJSJ_PARSED"))) \
        .unionByName(part(B.awards(t), "award_year", "XSBH", [F.col("FFJE")], KY.term_from_year("PDXN")))
    return QL.period_key_quality(k)


# ---- windowed event features (batch twin of the streaming operator) ----

@query("event_windows", """
SELECT CAST(user_id AS VARCHAR) AS entity_id, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS events,
       avg(CASE WHEN event_type IN ('view', 'click') THEN 1.0 ELSE 0.0 END) AS present_rate,
       avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS ungraded_rate, sum(value) AS value_sum
FROM events GROUP BY ALL""")
def q_event_windows(spark, sf_dir):
    return EV.window_features(_t(spark, sf_dir).events, "1 day")
