"""DuckDB SQL twins of `termlens.sources.bindings` and the mart operators, as named CTEs.

`with_ctes(final_sql, *names)` prepends the CTEs a query needs (dependencies resolved in order).
"""

from __future__ import annotations

import re

PERIOD = ("CAST(year({d}) AS VARCHAR) || '-' || CAST(year({d}) + 1 AS VARCHAR) || '-' || "
          "CASE WHEN month({d}) >= 8 THEN '1' ELSE '2' END")


def period(d: str) -> str:
    return "(" + PERIOD.format(d=d) + ")"


def year_term(y: str) -> str:
    """P3 on a number-like text: y-(y+1)-2."""
    yi = f"TRY_CAST(TRY_CAST({y} AS DOUBLE) AS INTEGER)"
    return f"(CAST({yi} AS VARCHAR) || '-' || CAST({yi} + 1 AS VARCHAR) || '-2')"


def ym_term(y: str, m: str) -> str:
    yi = f"TRY_CAST(TRY_CAST({y} AS DOUBLE) AS INTEGER)"
    mm = f"TRY_CAST({m} AS DOUBLE)"
    return (f"(CASE WHEN {yi} IS NOT NULL AND {mm} IS NOT NULL THEN CAST({yi} AS VARCHAR) || '-' || "
            f"CAST({yi} + 1 AS VARCHAR) || '-' || CASE WHEN {mm} >= 8 THEN '1' ELSE '2' END END)")


def nn(c: str) -> str:
    """normalize_null: trimmed text, blank / nan -> NULL."""
    return f"(CASE WHEN trim({c}) = '' OR lower(trim({c})) = 'nan' THEN NULL ELSE trim({c}) END)"


D1 = "CAST(1 AS DOUBLE)"
D0 = "CAST(0 AS DOUBLE)"

CTES: dict[str, str] = {}

CTES["order_lines"] = """
  SELECT l.*, o.o_custkey, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

CTES["src_grades"] = f"""
  SELECT CAST(o_custkey AS VARCHAR) AS XH, {period('o_orderdate')} AS ZXJXJHH,
         l_quantity * 2 AS KCCJ, l_discount * 40 AS JDCJ, 100 - l_quantity AS BY1
  FROM order_lines"""

_STATE = ("CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN 5 "
          "WHEN event_type = 'signup' THEN 0 WHEN event_type = 'purchase' THEN 99 END")
CTES["src_signin"] = f"""
  SELECT CAST(user_id AS VARCHAR) AS LOGIN_NAME, {_STATE} AS ACTIVE_STATE,
         json_extract_string(props, '$.k') AS CLASSID, 'class_' || json_extract_string(props, '$.k') AS CLASSNAME
  FROM events"""

CTES["src_homework"] = """
  SELECT CAST(user_id AS VARCHAR) AS CREATER_LOGIN_NAME,
         CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS IS_UNGRADED,
         CAST(floor(value * 8) AS DOUBLE) AS ANSWER_DURATION_SEC,
         CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '00:' || strftime(ts, '%M:%S') END
           AS CREATER_TIME,
         '00:' || strftime(ts + to_seconds(CAST(floor(value * 8) AS BIGINT)), '%M:%S') AS ANSWER_TIME,
         json_extract_string(props, '$.k') AS CLASS_ID, 'class_' || json_extract_string(props, '$.k') AS CLASS_NAME
  FROM events"""

CTES["src_online"] = """
  SELECT CAST(user_id AS VARCHAR) AS LOGIN_NAME, least(value, 100.0) AS BFB FROM events"""

CTES["src_fitness_term"] = """
  SELECT CAST(o_custkey AS VARCHAR) AS XH,
         CAST(year(l_shipdate) AS VARCHAR) || '-' || CAST(year(l_shipdate) + 1 AS VARCHAR) || '学年第' ||
         CASE WHEN month(l_shipdate) >= 8 THEN '1' ELSE '2' END || '学期' AS XQ,
         l_extendedprice / 1000.0 AS SJCJ, l_tax * 100 AS HSCJ
  FROM order_lines"""

CTES["src_fitness_year"] = """
  SELECT CAST(o_custkey AS VARCHAR) AS XH, CAST(CAST(year(l_shipdate) AS DOUBLE) AS VARCHAR) AS TCNF,
         l_tax * 1000 AS ZF, l_extendedprice AS FHL, l_quantity AS WS, l_discount * 100 AS LDTY,
         CAST(l_linenumber AS DOUBLE) AS ZWTQQ
  FROM order_lines"""

CTES["src_assessment"] = """
  SELECT CAST(o_custkey AS VARCHAR) AS XH, CAST(year(o_orderdate) AS VARCHAR) AS PDXN,
         CAST(month(o_orderdate) AS VARCHAR) AS PDXQ, o_totalprice / 1000.0 AS ZF,
         CAST(o_orderkey % 50 + 1 AS DOUBLE) AS BJPM, CAST(o_orderkey % 300 + 1 AS DOUBLE) AS ZYPM
  FROM orders"""

CTES["src_awards"] = """
  SELECT CAST(o_custkey AS VARCHAR) AS XSBH, CAST(CAST(year(o_orderdate) AS DOUBLE) AS VARCHAR) AS PDXN,
         o_totalprice / 100.0 AS FFJE
  FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"""

CTES["src_language_exam"] = """
  SELECT CAST(o_custkey AS VARCHAR) AS KS_XH, o_totalprice / 1000.0 AS KS_CJ,
         CASE WHEN o_orderstatus = 'F' THEN CAST(6 AS DOUBLE) ELSE CAST(4 AS DOUBLE) END AS KS_YYJB
  FROM orders WHERE o_orderpriority = '2-HIGH'"""

CTES["src_contests"] = """
  SELECT CAST(o_custkey AS VARCHAR) AS XHHGH, o_orderdate AS HJSJ_PARSED FROM orders WHERE o_orderstatus = 'P'"""

CTES["src_status_changes"] = """
  SELECT CAST(o_custkey AS VARCHAR) AS XH, o_orderdate AS BY1_parsed,
         CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) WHEN o_orderstatus = 'O' THEN CAST(2 AS DOUBLE)
              WHEN o_orderstatus = 'P' THEN CAST(3 AS DOUBLE) END AS YDLBDM
  FROM orders WHERE o_orderpriority = '5-LOW'"""

CTES["src_basic_info"] = """
  SELECT CAST(c_custkey AS VARCHAR) AS XH, CASE WHEN c_acctbal >= 0 THEN 'M' ELSE 'F' END AS XB,
         'E' || right(c_name, 1) AS MZMC, c_mktsegment AS ZZMMMC, r_name AS XSM, n_name AS ZYM
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""

# ---- mart blocks (A1-A12) ----

CTES["blk_grade"] = f"""
  SELECT XH, TERM_KEY, count(KCCJ) AS grade_course_cnt, avg(KCCJ) AS kccj_mean, median(KCCJ) AS kccj_median,
         avg(CASE WHEN KCCJ IS NULL THEN NULL WHEN KCCJ < 60 THEN {D1} ELSE {D0} END) AS kccj_fail_rate,
         avg(JDCJ) AS jdcj_mean, avg(BY1) AS by1_mean
  FROM (SELECT {nn('XH')} AS XH, {nn('ZXJXJHH')} AS TERM_KEY, TRY_CAST(KCCJ AS DOUBLE) AS KCCJ,
               TRY_CAST(JDCJ AS DOUBLE) AS JDCJ, TRY_CAST(BY1 AS DOUBLE) AS BY1 FROM src_grades)
  WHERE XH IS NOT NULL AND TERM_KEY IS NOT NULL
  GROUP BY XH, TERM_KEY"""

_XQ_RE = r"(\d{4})\s*-\s*(\d{4}).*?第\s*([12])\s*学期"
CTES["blk_fit_term"] = f"""
  SELECT XH, TERM_KEY, avg(SJCJ) AS fit_sjcj_mean, avg(HSCJ) AS fit_hscj_mean
  FROM (SELECT XH, CASE WHEN regexp_extract(XQ, '{_XQ_RE}', 1) <> '' AND regexp_extract(XQ, '{_XQ_RE}', 3) <> ''
                    THEN regexp_extract(XQ, '{_XQ_RE}', 1) || '-' || regexp_extract(XQ, '{_XQ_RE}', 2) || '-' ||
                         regexp_extract(XQ, '{_XQ_RE}', 3) END AS TERM_KEY,
               SJCJ, HSCJ FROM src_fitness_term WHERE XH IS NOT NULL AND XQ IS NOT NULL)
  WHERE TERM_KEY IS NOT NULL
  GROUP BY XH, TERM_KEY"""

CTES["blk_fit_year"] = f"""
  SELECT XH, TERM_KEY, avg(ZF) AS fit3_zf_mean, avg(FHL) AS fit3_fhl_mean, avg(WS) AS fit3_ws_mean,
         avg(LDTY) AS fit3_ldty_mean, avg(ZWTQQ) AS fit3_zwtqq_mean
  FROM (SELECT XH, {year_term('TCNF')} AS TERM_KEY, ZF, FHL, WS, LDTY, ZWTQQ FROM src_fitness_year)
  WHERE XH IS NOT NULL AND TERM_KEY IS NOT NULL
  GROUP BY XH, TERM_KEY"""

CTES["zc_rows"] = f"""
  SELECT XH, {ym_term('PDXN', 'PDXQ')} AS TERM_KEY, ZF, BJPM, ZYPM FROM src_assessment"""
CTES["zc_kept"] = """
  SELECT * FROM zc_rows WHERE XH IS NOT NULL AND TERM_KEY IS NOT NULL"""
CTES["zc_stats"] = """
  SELECT avg(CASE WHEN ZF IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.05 AS zf_ok,
         avg(CASE WHEN ZYPM IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.05 AS zypm_ok,
         count(BJPM) > 0 AS bjpm_any
  FROM zc_kept"""
CTES["blk_zc_term"] = """
  SELECT XH, TERM_KEY, avg(ZF) AS zc_zf_mean, avg(BJPM) AS zc_bjpm_mean_term, avg(ZYPM) AS zc_zypm_mean_term
  FROM zc_kept WHERE (SELECT zf_ok OR zypm_ok FROM zc_stats)
  GROUP BY XH, TERM_KEY"""
CTES["blk_zc_entity"] = """
  SELECT XH, count(*) AS zc_records,
         CASE WHEN (SELECT bjpm_any FROM zc_stats) THEN min(BJPM) END AS zc_bjpm_best,
         CASE WHEN (SELECT bjpm_any FROM zc_stats) THEN avg(BJPM) END AS zc_bjpm_mean,
         CASE WHEN (SELECT zypm_ok FROM zc_stats) THEN min(ZYPM) END AS zc_zypm_best,
         CASE WHEN (SELECT zypm_ok FROM zc_stats) THEN avg(ZYPM) END AS zc_zypm_mean
  FROM zc_kept GROUP BY XH"""

CTES["sch_rows"] = f"""
  SELECT XSBH AS XH, {year_term('PDXN')} AS TERM_KEY, TRY_CAST(FFJE AS DOUBLE) AS FFJE FROM src_awards"""
CTES["blk_sch_entity"] = """
  SELECT XH, count(*) AS sch_cnt, coalesce(sum(FFJE), 0) AS sch_amt_sum FROM sch_rows WHERE XH IS NOT NULL GROUP BY XH"""
CTES["blk_sch_term"] = """
  SELECT XH, TERM_KEY, count(*) AS sch_cnt_term, coalesce(sum(FFJE), 0) AS sch_amt_sum_term
  FROM sch_rows WHERE XH IS NOT NULL AND TERM_KEY IS NOT NULL GROUP BY XH, TERM_KEY"""

CTES["blk_cet"] = """
  SELECT KS_XH AS XH, max(KS_CJ) AS cet_score_max, max(KS_YYJB) AS cet_level_max
  FROM src_language_exam WHERE KS_XH IS NOT NULL GROUP BY KS_XH"""

CTES["comp_rows"] = f"""
  SELECT XHHGH AS XH, {period('HJSJ_PARSED')} AS TERM_KEY FROM src_contests"""
CTES["blk_comp_entity"] = """
  SELECT XH, count(*) AS comp_cnt FROM comp_rows WHERE XH IS NOT NULL GROUP BY XH"""
CTES["blk_comp_term"] = """
  SELECT XH, TERM_KEY, count(*) AS comp_cnt_term FROM comp_rows
  WHERE XH IS NOT NULL AND TERM_KEY IS NOT NULL GROUP BY XH, TERM_KEY"""

CTES["blk_yd"] = f"""
  SELECT XH, TERM_KEY, count(*) AS yd_cnt, count(DISTINCT YDLBDM) AS yd_type_nunique
  FROM (SELECT XH, {period('BY1_parsed')} AS TERM_KEY, YDLBDM FROM src_status_changes)
  WHERE XH IS NOT NULL AND TERM_KEY IS NOT NULL GROUP BY XH, TERM_KEY"""

CTES["blk_online"] = """
  SELECT LOGIN_NAME AS XH, avg(BFB) AS online_bfb FROM src_online WHERE LOGIN_NAME IS NOT NULL GROUP BY LOGIN_NAME"""

_TIME_RE = r"^\s*\d{1,2}:\d{2}:\d{2}\s*$"


def _secs(c: str) -> str:
    return (f"(TRY_CAST(split_part(trim({c}), ':', 1) AS DOUBLE) * 3600 + "
            f"TRY_CAST(split_part(trim({c}), ':', 2) AS DOUBLE) * 60 + TRY_CAST(split_part(trim({c}), ':', 3) AS DOUBLE))")


CTES["hw_rows"] = f"""
  SELECT CREATER_LOGIN_NAME AS XH, IS_UNGRADED,
         CASE WHEN coalesce(regexp_matches(CREATER_TIME, '{_TIME_RE}'), false)
                   AND coalesce(regexp_matches(ANSWER_TIME, '{_TIME_RE}'), false)
              THEN CASE WHEN {_secs('ANSWER_TIME')} - {_secs('CREATER_TIME')} < 0
                        THEN {_secs('ANSWER_TIME')} - {_secs('CREATER_TIME')} + 3600
                        ELSE {_secs('ANSWER_TIME')} - {_secs('CREATER_TIME')} END
              ELSE ANSWER_DURATION_SEC END AS DUR_FIXED
  FROM src_homework"""
CTES["blk_hw"] = """
  SELECT XH, count(*) AS hw_submit_cnt, avg(IS_UNGRADED) AS hw_ungraded_rate, median(DUR_FIXED) AS hw_duration_median
  FROM hw_rows WHERE XH IS NOT NULL GROUP BY XH"""

CTES["blk_att"] = f"""
  SELECT LOGIN_NAME AS XH, count(*) AS att_event_cnt,
         avg(coalesce(CAST(ACTIVE_STATE = 1 AS DOUBLE), {D0})) AS att_present_rate,
         avg(coalesce(CAST(ACTIVE_STATE = 5 AS DOUBLE), {D0})) AS att_absent_rate,
         avg(coalesce(CAST(ACTIVE_STATE NOT IN (0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12) AND ACTIVE_STATE IS NOT NULL
                      AS DOUBLE), {D0})) AS att_abnormal_rate
  FROM src_signin WHERE LOGIN_NAME IS NOT NULL GROUP BY LOGIN_NAME"""

MART_COLUMNS = """grade_course_cnt kccj_mean kccj_median kccj_fail_rate jdcj_mean by1_mean fit_sjcj_mean fit_hscj_mean
fit3_zf_mean fit3_fhl_mean fit3_ws_mean fit3_ldty_mean fit3_zwtqq_mean zc_zf_mean zc_bjpm_mean_term zc_zypm_mean_term
yd_cnt yd_type_nunique online_bfb hw_submit_cnt hw_ungraded_rate hw_duration_median att_event_cnt att_present_rate
att_absent_rate att_abnormal_rate zc_records zc_bjpm_best zc_bjpm_mean zc_zypm_best zc_zypm_mean sch_cnt sch_amt_sum
sch_cnt_term sch_amt_sum_term cet_score_max cet_level_max comp_cnt comp_cnt_term""".split()

CTES["mart"] = f"""
  SELECT g.XH AS entity_id, g.TERM_KEY AS period_key, {', '.join(MART_COLUMNS)}
  FROM blk_grade g
  LEFT JOIN blk_fit_term USING (XH, TERM_KEY)
  LEFT JOIN blk_fit_year USING (XH, TERM_KEY)
  LEFT JOIN blk_zc_term USING (XH, TERM_KEY)
  LEFT JOIN blk_yd USING (XH, TERM_KEY)
  LEFT JOIN blk_sch_term USING (XH, TERM_KEY)
  LEFT JOIN blk_comp_term USING (XH, TERM_KEY)
  LEFT JOIN blk_online USING (XH)
  LEFT JOIN blk_hw USING (XH)
  LEFT JOIN blk_att USING (XH)
  LEFT JOIN blk_zc_entity USING (XH)
  LEFT JOIN blk_sch_entity USING (XH)
  LEFT JOIN blk_cet USING (XH)
  LEFT JOIN blk_comp_entity USING (XH)"""

MART_BIGINT = """grade_course_cnt yd_cnt yd_type_nunique hw_submit_cnt att_event_cnt zc_records sch_cnt sch_cnt_term
comp_cnt comp_cnt_term""".split()

_IDENT = re.compile(r"\b([a-z_][a-z0-9_]*)\b")


def _deps(body: str) -> list[str]:
    return [w for w in dict.fromkeys(_IDENT.findall(body)) if w in CTES]


def with_ctes(final_sql: str, *names: str) -> str:
    """Prepend the CTEs referenced by `final_sql` (or listed in `names`) with their dependencies."""
    order: list[str] = []

    def visit(n: str, stack: tuple = ()):
        if n in order or n in stack:
            return
        for d in _deps(CTES[n]):
            if d != n:
                visit(d, stack + (n,))
        order.append(n)

    for n in list(names) + _deps(final_sql):
        visit(n)
    if not order:
        return final_sql
    head = ",\n".join(f"{n} AS ({CTES[n]}\n)" for n in order)
    body = final_sql.lstrip()
    if body[:5].upper() == "WITH ":
        return "WITH " + head + ",\n" + body[5:]
    return "WITH " + head + "\n" + final_sql
