"""Edge rows for the scalar rules on hand-built frames."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from termlens.functions import keys as K
from termlens.functions import text as TX
from termlens.functions.nulls import is_missing_value, mean_of_rounded, normalize_null, np_round, to_number
from termlens.operators import profiles as PR
from termlens.operators import scores as S


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("o")).collect()]


def test_term_from_text_spaces_and_garbage(spark):
    got = _one(spark, K.term_from_text("x"), [("2020-2021学年第2学期",), ("2020-2021 学年第 2 学期",), ("nan",), ("abc",), (None,)],
               "x string")
    assert got == ["2020-2021-2", "2020-2021-2", None, None, None]


def test_term_from_year_float_text(spark):
    got = _one(spark, K.term_from_year("y"), [("2020.0",), ("2021",), ("abc",), (None,)], "y string")
    assert got == ["2020-2021-2", "2021-2022-2", None, None]


def test_term_from_year_month_boundary(spark):
    got = _one(spark, K.term_from_year_month("y", "m"), [("2020", "7"), ("2020", "8"), ("2020", None)], "y string, m string")
    assert got == ["2020-2021-2", "2020-2021-1", None]


def test_term_from_date_calendar_convention_and_bad_date(spark):
    got = _one(spark, K.term_from_date("d"), [("2021-03-05",), ("2021-09-01 10:00:00",), ("not a date",)], "d string")
    assert got == ["2021-2022-2", "2021-2022-1", None]


def test_duration_fix_deltas(spark):
    rows = [("00:10:00", "00:10:00", 5.0), ("00:10:01", "00:10:00", 5.0), ("01:00:00", "00:00:00", 5.0),
            ("01:23:20", "00:00:00", 5.0), ("2024-01-01 00:00:00", "00:00:01", 42.0)]
    got = _one(spark, K.duration_fix("c", "a", "r"), rows, "c string, a string, r double")
    assert got == [0.0, 3599.0, 0.0, -1400.0, 42.0]     # one +3600 only (Q2); non time-only -> recorded


def test_normalize_id_and_looks_like_id(spark):
    got = _one(spark, K.normalize_id("x"), [("123.0",), ('"123"',), ("'abc'",), (" x ",), (None,), (".0",), ("1.05",)], "x string")
    assert got == ["123", "123", "abc", "x", "", "", "1.05"]
    like = _one(spark, K.looks_like_id("x"), [("PJabcd",), ("pj12",), ("xpjabcd",), (None,)], "x string")
    assert like == [True, False, False, False]


def test_to_number_nan_and_text(spark):
    got = _one(spark, to_number("x"), [("1.5",), ("NaN",), ("x",), (None,)], "x string")
    assert got == [1.5, None, None, None]


def test_np_round_matches_numpy_ties(spark):
    import numpy as np
    vals = [0.03125, 80.72625, 2.5, -0.00015, 12.25, 1e-5]
    got = _one(spark, np_round("x", 4), [(v,) for v in vals], "x double")
    assert got == [float(np.round(v, 4)) for v in vals]


def test_mean_of_rounded_is_order_free(spark):
    df = spark.createDataFrame([(0.7405,), (0.7406,)], "x double")
    assert df.agg(mean_of_rounded("x")).first()[0] == 0.7406   # exact tie 0.74055 -> half to even


def test_score_level_thresholds(spark):
    got = _one(spark, S.score_level("s"), [(1.5,), (0.5,), (0.2,), (0.19,), (-0.2,), (-1.6,)], "s double")
    assert got == ["显著偏高", "明显偏高", "偏高", "接近均值", "偏低", "显著偏低"]


def test_hard_label_first_on_ties_and_entropy(spark):
    df = spark.createDataFrame([([0.25, 0.25, 0.5, 0.0],), ([0.5, 0.5, 0.0, 0.0],)], "p array<double>")
    r = df.select(S.hard_label(F.col("p")).alias("l"), S.entropy(F.col("p")).alias("e"), S.psecond(F.col("p")).alias("s")).collect()
    assert [x["l"] for x in r] == [2, 0]
    assert math.isclose(r[1]["e"], math.log(2), rel_tol=1e-9)
    assert r[1]["s"] == 0.5
    one = spark.createDataFrame([([1.0],)], "p array<double>").select(S.psecond(F.col("p"))).first()[0]
    assert one == 0.0                                     # k = 1 posterior: second = 0


def test_evidence_text_edges(spark):
    cols = ", ".join(f"{d} double" for d in PR.C.DIM_COLS) + ", " + ", ".join(f"{m} double" for m in PR.C.KEY_METRICS)
    n = len(PR.C.DIM_COLS) + len(PR.C.KEY_METRICS)
    none = tuple([None] * n)
    small = tuple([0.1] * len(PR.C.DIM_COLS) + [None] * len(PR.C.KEY_METRICS))
    one = tuple([-0.6] + [0.0] * (len(PR.C.DIM_COLS) - 1) + [12.25, 0.3] + [None] * (len(PR.C.KEY_METRICS) - 2))
    got = _one(spark, S.evidence_text(), [none, small, one], cols)
    assert got[0] == PR.C.EVIDENCE_NO_DATA
    assert got[1] == PR.C.EVIDENCE_BALANCED
    assert got[2] == "①学业明显偏低（课程成绩均值12.2分，挂科率30.0%）。"   # 12.25 -> 12.2 (half even)


def test_risk_level_boundaries(spark):
    got = _one(spark, PR.risk_level("r"), [(0.15,), (0.30,), (0.31,), (0.16,)], "r double")
    assert got == ["good", "watch", "high", "watch"]


def test_mask_field_names(spark):
    got = _one(spark, TX.mask_field_names("t"), [("dim_academic and p_mode_3, mode_2_pct; dim_foo_bar kccj_mean_avg",)], "t string")
    assert got == ["学业维度 and 模式3概率, 模式2占比; 维度分 课程成绩均值"]


def test_strip_markup(spark):
    rows = [("**重点** 3*5\r\n---\n总览解读：内容 1. 第一 2. 第二",), ("建议：多读书",), ("前文 *强调* 一、甲 二、乙。 👉 丙",), ("a --- b",), ("",), (None,)]
    got = _one(spark, TX.strip_markup("t"), rows, "t string")
    assert got == ["重点 3*5\n\n总览解读：\n内容\n1. 第一\n2. 第二", "建议：\n多读书", "前文 强调\n\n一、甲\n\n二、乙。\n👉 丙", "a\n\nb", "", ""]


def test_white_space_is_trimmed_on_both_ends(spark):
    rows = [("\tnan\n",), ("\t",), ("\u3000x y\u00a0",), (" NaN ",), (None,)]
    assert _one(spark, normalize_null("t"), rows, "t string") == [None, None, "x y", None, None]
    assert _one(spark, is_missing_value("t"), rows, "t string") == [True, True, False, True, True]
    assert _one(spark, K.normalize_id("t"), [("\t12.0\n",), ('"\tpj0 "',)], "t string") == ["12", "pj0"]


def test_exact_quantiles_equal_percentile(spark):
    from termlens.operators import quantiles as Q
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 911) / 3).alias("a"),
                                  F.when(F.col("id") % 3 == 0, F.lit(5.0)).alias("b"), F.lit(None).cast("double").alias("c"))
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for accuracy in (Q.ACCURACY, 40):                  # groups ordered whole, groups bracketed by sketches
        got = {(r["g"], r["feature"]): [r[f"q{i}"] for i in range(len(qs))]
               for r in Q.exact_quantiles(df, ["a", "b", "c"], qs, ["g"], accuracy=accuracy).collect()}
        for r in df.groupBy("g").agg(F.percentile("a", F.array(*map(F.lit, qs))).alias("a"), F.percentile("b", F.array(*map(F.lit, qs))).alias("b")).collect():
            for c in "ab":
                want = r[c]
                assert (got.get((r["g"], c)) is None) == (want is None)
                assert want is None or all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(got[r["g"], c], want))
        assert Q.quantile_values(df, ["c"], [0.5]) == {"c": [None]}


def test_optimal_assignment_of_any_size():
    import itertools
    import random
    from termlens.operators.cluster import optimal_assignment
    rnd = random.Random(4)
    for k in (1, 2, 5, 6):
        c = [[rnd.random() for _ in range(k)] for _ in range(k)]
        a = optimal_assignment(c)
        assert sorted(a) == list(range(k))
        assert math.isclose(sum(c[i][a[i]] for i in range(k)), min(sum(c[i][p[i]] for i in range(k)) for p in itertools.permutations(range(k))))
    assert optimal_assignment([[0 if (i + 5) % 20 == j else 1 for j in range(20)] for i in range(20)]) == [(i + 5) % 20 for i in range(20)]


def test_classify_intent_priority(spark):
    got = _one(spark, TX.classify_intent("m"), [("页面解读 和 建议",), ("页面分析",), ("给点建议",), ("hello",), (None,)], "m string")
    assert got == ["explain", "analyze", "suggest", "analyze", "analyze"]
