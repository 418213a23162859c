"""Text rules as column expressions (TX1-TX3, TX5): keyword intent, field-name masking, markup stripping,
report text. All are built-in regex / string functions: they run inside whole-stage codegen, never a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termlens.functions.nulls import np_round

# Intent keywords in priority order.
INTENT_RULES = [("explain", ("页面解读", "页面讲解")), ("analyze", ("页面分析",)), ("suggest", ("建议",))]
INTENT_DEFAULT = "analyze"

# Internal field name -> display label (whole-word replacement).
FIELD_LABELS = {
    "dim_academic": "学业维度",
    "dim_attendance_engagement": "出勤参与维度",
    "dim_homework_behavior": "作业行为维度",
    "dim_online_learning": "线上学习维度",
    "dim_fitness": "体能维度",
    "dim_development": "发展成就维度",
    "kccj_mean_avg": "课程成绩均值",
    "kccj_fail_rate_avg": "挂科率",
    "att_present_rate_avg": "出勤率",
    "online_bfb_avg": "线上完成率",
    "risk_pct": "高风险比例",
}
P_MODE_LABEL = "模式$1概率"
MODE_PCT_LABEL = "模式$1占比"
DIM_FALLBACK = "维度分"

# Section titles that start a new paragraph in model text.
SECTION_TITLES = "总览解读|趋势解读|风险总览解读|模式分析|当前选中模式解释|当前选中模式解读|当前模式解释|可执行建议|建议"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def classify_intent(msg) -> Column:
    """TX1: explain / analyze / suggest by keywords in priority order; default analyze."""
    m = F.trim(F.coalesce(_c(msg), F.lit("")))
    e = None
    for intent, kws in INTENT_RULES:
        cond = None
        for k in kws:
            cond = m.contains(k) if cond is None else (cond | m.contains(k))
        e = F.when(cond, F.lit(intent)) if e is None else e.when(cond, F.lit(intent))
    return e.otherwise(F.lit(INTENT_DEFAULT))


def mask_field_names(text) -> Column:
    """TX2: internal names replaced word by word: listed names by their label, p_mode_N / mode_N_pct by the mode labels,
    any other dim_* by the fallback. One pass over the word and non-word runs of the text."""
    labels = F.create_map(*[F.lit(x) for kv in FIELD_LABELS.items() for x in kv])
    runs = F.regexp_extract_all(F.coalesce(_c(text).cast("string"), F.lit("")), F.lit(r"(\w+|\W+)"), 1)

    def shown(w: Column) -> Column:
        return F.coalesce(labels[w], F.when(w.rlike(r"^p_mode_\d+$"), F.regexp_replace(w, r"^p_mode_(\d+)$", P_MODE_LABEL))
                          .when(w.rlike(r"^mode_\d+_pct$"), F.regexp_replace(w, r"^mode_(\d+)_pct$", MODE_PCT_LABEL))
                          .when(w.rlike(r"^dim_[a-z_]+$"), F.lit(DIM_FALLBACK)).otherwise(w))

    return F.array_join(F.transform(runs, shown), "")


# Symbols that start a line of their own.
POINT_SYMBOLS = "👉✅📌➡️"
#: where a line is cut: before a section title, a counted item, a numbered item or a point symbol
_CUTS = (rf"(?={'(?:' + SECTION_TITLES + ')'}\s*：)", r"(?<![一二三四五六七八九十])(?=[一二三四五六七八九十]+、)", r"\s+(?=\d+\.\s)", rf"\s+(?=[{POINT_SYMBOLS}])")
_TITLE = rf"^(?:{SECTION_TITLES})\s*："
_COUNTED = r"^[一二三四五六七八九十]+、"


def strip_markup(text) -> Column:
    """TX3: model text as plain paragraphs.

    The text becomes a list of lines; a rule (three or more of - * _) ends a paragraph, emphasis marks go (a star next to a digit is
    a product and stays), and every line is cut into parts at titles and items. Parts are then classed: a title opens a
    paragraph and stands on its own line, a counted item opens a paragraph, any other part is a line. Blank
    lines are squeezed to one, none stay at the ends."""
    ws = "\\s\u3000\u00a0"
    lines = F.split(F.coalesce(_c(text).cast("string"), F.lit("")), r"\r?\n")

    def parts(line: Column) -> Column:
        plain = F.regexp_replace(F.replace(line, F.lit("**"), F.lit("")), r"(?<!\d)\*(?!\d)([^*]*)\*(?!\d)", "$1")
        return F.flatten(F.transform(F.split(plain, r"\s*-{3,}\s*"), lambda p: F.concat(
            F.array(F.lit("")), F.split(p, "|".join(_CUTS)), F.array(F.lit("")))))

    def shown(p: Column) -> Column:
        body = F.regexp_replace(p, f"^[{ws}]+|[{ws}]+$", "")
        title = F.regexp_replace(F.regexp_extract(body, _TITLE, 0), r"\s*：$", "：")
        rest = F.regexp_replace(body, _TITLE + rf"[{ws}]*", "")
        return (F.when(title != "", F.array(F.lit(""), title, rest))
                .when(body.rlike(_COUNTED), F.array(F.lit(""), body)).otherwise(F.array(body)))

    def cut(line: Column) -> Column:
        ruled = line.rlike(rf"^[{ws}]*[-*_]{{3,}}[{ws}]*$")
        pieces = F.when(ruled, F.array(F.lit(""))).otherwise(F.when(line.rlike("-{3,}"), parts(line)).otherwise(
            F.slice(parts(line), F.lit(2), F.size(parts(line)) - 2)))
        return F.flatten(F.transform(pieces, shown))

    joined = F.array_join(F.flatten(F.transform(lines, cut)), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), f"^[{ws}]+|[{ws}]+$", "")


def fmt1(v) -> Column:
    """One decimal after NumPy-style rounding (half-even on the binary value, sign kept: -0.04 -> "-0.0")."""
    return F.format_string("%.1f", np_round(_c(v).cast("double"), 1))


def pct1(v) -> Column:
    return F.format_string("%.1f%%", np_round(_c(v).cast("double") * 100, 1))
