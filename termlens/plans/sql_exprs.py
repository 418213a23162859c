"""DuckDB SQL twins of the scoring / profile expressions, added to the shared CTE dictionary."""

from __future__ import annotations

from termlens import config as C
from termlens.operators.scores import score_inputs
from termlens.plans.sql_bindings import CTES

K = C.N_MODES
P_COLS = [f"p_mode_{i}" for i in range(K)]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mode_name_sql(c: str) -> str:
    return "(CASE " + " ".join(f"WHEN {c} = {i} THEN {q(C.MODE_NAMES[i])}" for i in range(K)) + " END)"


def subtype_name_sql(c: str) -> str:
    return f"map_extract_value(MAP([{', '.join(str(k) for k in C.SUBTYPE_NAMES)}], [{', '.join(q(v) for v in C.SUBTYPE_NAMES.values())}]), {c})"


def score_level_sql(x: str) -> str:
    w = f"(CASE WHEN {x} > 0 THEN '高' ELSE '低' END)"
    return (f"(CASE WHEN abs({x}) >= {C.LEVEL_STRONG} THEN '显著偏' || {w} WHEN abs({x}) >= {C.LEVEL_CLEAR} THEN '明显偏' || {w} "
            f"WHEN abs({x}) >= {C.LEVEL_SLIGHT} THEN '偏' || {w} ELSE {q(C.LEVEL_NEAR)} END)")


def _fmt(v: str, kind: str, suffix: str) -> str:
    if kind == "pct1":
        return f"printf('%.1f%%', round_even({v} * 100, 1))"
    if kind == "f1":
        return f"printf('%.1f', round_even({v}, 1)) || {q(suffix)}"
    return f"printf('%.0f', round_even({v}, 0)) || {q(suffix)}"


def _detail(dim: str) -> str:
    items = [f"CASE WHEN {m} IS NOT NULL THEN {q(label)} || {_fmt(f'CAST({m} AS DOUBLE)', kind, suf)} END"
             for m, label, kind, suf in C.DIM_EVIDENCE.get(dim, [])]
    if not items:
        return "''"
    return f"array_to_string(list_slice(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), 1, 2), '，')"


def evidence_sql() -> str:
    entries = []
    for i, d in enumerate(C.DIM_COLS):
        name = q(C.DIM_NAMES_CN[d])
        det = _detail(d)
        part = (f"CASE WHEN {det} <> '' THEN {name} || {score_level_sql(d)} || '（' || {det} || '）' "
                f"ELSE {name} || {score_level_sql(d)} END")
        entries.append(f"CASE WHEN {d} IS NOT NULL THEN {{'neg_abs': -abs({d}), 'idx': {i}, 'part': {part}}} END")
    arr = f"list_sort(list_filter([{', '.join(entries)}], lambda x: x IS NOT NULL))"
    nums = "[" + ", ".join(q(n) for n in C.EVIDENCE_NUMBERS) + "]"
    return f"""(SELECT CASE WHEN len(a) = 0 THEN {q(C.EVIDENCE_NO_DATA)}
                 WHEN -a[1].neg_abs < {C.EVIDENCE_BALANCED_MAX} THEN {q(C.EVIDENCE_BALANCED)}
                 WHEN len(list_slice(list_filter(a, lambda x: -x.neg_abs >= {C.EVIDENCE_SKIP}), 1, 3)) = 0
                   THEN {q(C.EVIDENCE_BALANCED)}
                 ELSE array_to_string(list_transform(list_slice(list_filter(a, lambda x: -x.neg_abs >= {C.EVIDENCE_SKIP}), 1, 3),
                        lambda x, i: {nums}[i] || x.part), '；') || '。' END
        FROM (SELECT {arr} AS a))"""


INPUTS = score_inputs()

CTES["zstats"] = "\n  SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in INPUTS) + " FROM mart"


def z_sql(c: str) -> str:
    return (f"((coalesce(CAST({c} AS DOUBLE), zs.m_{c}) - zs.m_{c}) / "
            f"CASE WHEN zs.s_{c} IS NULL OR isnan(zs.s_{c}) OR zs.s_{c} < {C.Z_EPS} THEN 1 ELSE zs.s_{c} END)")


def dims_sql() -> list[str]:
    out = []
    for dim, comps in C.DIM_WEIGHTS.items():
        out.append(" + ".join(f"{float(w)} * {z_sql(m)}" for m, w in comps) + f" AS {dim}")
    return out


_W = [f"CAST(1 + ((CAST(grade_course_cnt AS BIGINT) * {i + 1} + CAST(entity_id AS BIGINT) * {i + 3}) % 11) AS DOUBLE)"
      for i in range(K)]
CTES["scored_p"] = f"""
  SELECT entity_id, period_key, grade_course_cnt,
         {', '.join(f'{_W[i]} / ({" + ".join(_W)}) AS p_mode_{i}' for i in range(K))},
         {', '.join(dims_sql())}, {', '.join(C.KEY_METRICS)}
  FROM mart, zstats zs"""

_PL = "[" + ", ".join(P_COLS) + "]"
CTES["scored"] = f"""
  SELECT entity_id, period_key, {K} AS mode_k, mode_id, {', '.join(P_COLS)}, mode_pmax, mode_pmax - mode_psecond AS mode_margin,
         mode_entropy, CASE WHEN local IS NULL OR local = -1 THEN NULL ELSE CAST(mode_id * 100 + local AS INTEGER) END AS subtype_id,
         CASE WHEN local IS NULL OR local = -1 THEN NULL
              ELSE 'mode' || CAST(mode_id AS VARCHAR) || '_sub' || CAST(local AS VARCHAR) END AS subtype_note,
         {', '.join(C.DIM_COLS)}, {', '.join(C.KEY_METRICS)}
  FROM (SELECT *, CAST(list_position({_PL}, list_max({_PL})) - 1 AS INTEGER) AS mode_id, list_max({_PL}) AS mode_pmax,
               list_sort({_PL}, 'DESC')[2] AS mode_psecond,
               -list_sum(list_transform({_PL}, lambda x: least(greatest(x, 1e-12), 1.0) * ln(least(greatest(x, 1e-12), 1.0))))
                 AS mode_entropy,
               CAST(grade_course_cnt % 4 AS INTEGER) AS local
        FROM scored_p)"""

CTES["class_votes"] = """
  SELECT XH, cid, cname, count(*) AS n FROM (
    SELECT CREATER_LOGIN_NAME AS XH, CLASS_ID AS cid, CLASS_NAME AS cname FROM src_homework
    UNION ALL SELECT LOGIN_NAME, CLASSID, CLASSNAME FROM src_signin)
  WHERE XH IS NOT NULL AND (cid IS NOT NULL OR cname IS NOT NULL)
  GROUP BY XH, cid, cname"""
CTES["class_map"] = """
  SELECT XH, cid AS CLASS_ID, cname AS CLASS_NAME, n AS class_votes FROM (
    SELECT *, row_number() OVER (PARTITION BY XH ORDER BY n DESC, cid ASC NULLS FIRST, cname ASC NULLS FIRST) AS rn
    FROM class_votes) WHERE rn = 1"""


def _r4(c: str) -> str:
    return f"round_even(CAST({c} AS DOUBLE), 4) AS {c}"


_ROUND = ["mode_pmax", "mode_margin", "mode_entropy", *P_COLS, *C.DIM_COLS]
CTES["profiles"] = f"""
  SELECT s.entity_id, s.period_key, b.XB, b.XSM, b.ZYM, cm.CLASS_NAME, s.mode_id, {mode_name_sql('s.mode_id')} AS mode_name,
         {', '.join(_r4(c) for c in ['mode_pmax', 'mode_margin', 'mode_entropy', *P_COLS])},
         s.subtype_id, {subtype_name_sql('s.subtype_id')} AS subtype_name, s.subtype_note, {evidence_sql()} AS mode_evidence,
         {', '.join(_r4(c) for c in C.DIM_COLS)},
         {', '.join(f'round_even(CAST({m} AS DOUBLE), 4) AS {m}' if m not in ('att_event_cnt', 'hw_submit_cnt') else m
                    for m in C.KEY_METRICS)}
  FROM scored s LEFT JOIN src_basic_info b ON s.entity_id = b.XH LEFT JOIN class_map cm ON s.entity_id = cm.XH"""


def mean_rounded_sql(c: str) -> str:
    return f"round_even(sum(round_even(CAST({c} AS DOUBLE) * 10000, 0)) / count({c}), 0) / 10000"


def group_profile_sql(group_col: str) -> str:
    counts = ", ".join(f"sum(CASE WHEN mode_id = {i} THEN 1 ELSE 0 END) AS c{i}" for i in range(K))
    arr = "[" + ", ".join(f"c{i}" for i in range(K)) + "]"
    dom = f"CAST(list_position({arr}, list_max({arr})) - 1 AS INTEGER)"
    return f"""
  SELECT {group_col}, period_key, n_records,
         {', '.join(f'round_even(CAST(c{i} AS DOUBLE) / n_records, 4) AS mode_{i}_pct' for i in range(K))},
         {dom} AS dominant_mode_id, {mode_name_sql(dom)} AS dominant_mode_name,
         {', '.join(f'{d}_mean' for d in C.DIM_COLS)}, {', '.join(f'{m}_avg' for m in C.KEY_METRICS)}
  FROM (SELECT {group_col}, period_key, count(*) AS n_records, {counts},
               {', '.join(f'{mean_rounded_sql(d)} AS {d}_mean' for d in C.DIM_COLS)},
               {', '.join(f'{mean_rounded_sql(m)} AS {m}_avg' for m in C.KEY_METRICS)}
        FROM profiles WHERE {group_col} IS NOT NULL AND trim(CAST({group_col} AS VARCHAR)) NOT IN ('', 'nan', 'None')
        GROUP BY {group_col}, period_key)"""


for _lv, _col in C.GROUP_LEVELS.items():
    CTES[f"grp_{_lv}"] = group_profile_sql(_col)

GROUP_NUMERIC = ([f"mode_{i}_pct" for i in range(K)] + [f"{d}_mean" for d in C.DIM_COLS]
                 + [f"{m}_avg" for m in C.KEY_METRICS])


def rollup_sql(level: str) -> str:
    col = C.GROUP_LEVELS[level]
    return (f"SELECT {col}, CASE WHEN sum(n_records) = 0 THEN NULL ELSE sum(n_records) END AS n_records, "
            + ", ".join(f"avg({c}) AS {c}" for c in GROUP_NUMERIC) + f" FROM grp_{level} GROUP BY {col}")


for _lv in C.GROUP_LEVELS:
    CTES[f"rollup_{_lv}"] = "\n  " + rollup_sql(_lv)


def risk_sql(prefix: str = "mode_", suffix: str = "_pct") -> str:
    return " + ".join(f"coalesce({prefix}{m}{suffix}, 0)" for m in C.RISK_MODES)


def risk_level_sql(x: str) -> str:
    return (f"CASE WHEN {x} > {C.RISK_HIGH} THEN '{C.RISK_LABELS[0]}' WHEN {x} > {C.RISK_WATCH} "
            f"THEN '{C.RISK_LABELS[1]}' ELSE '{C.RISK_LABELS[2]}' END")
