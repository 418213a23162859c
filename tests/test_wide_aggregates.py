"""Wide global aggregates are taken in turns, and the replayed chain computes one expression for all features."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from termlens.operators import prep as PP
from termlens.operators import prep_chain as PC
from termlens.operators import quality as QL

COLS = [f"f{i}" for i in range(12)]


@pytest.fixture
def widths(monkeypatch):
    seen, agg = [], DataFrame.agg
    monkeypatch.setattr(DataFrame, "agg", lambda self, *exprs: seen.append(len(exprs)) or agg(self, *exprs))
    return seen


def _table(spark):
    x = np.random.default_rng(8).normal(size=(400, len(COLS)))
    rows = [(i, *[None if (i + j) % 7 == 0 or j == 11 else v for j, v in enumerate(r)]) for i, r in enumerate(x.tolist())]
    return spark.createDataFrame(rows, f"id int, {', '.join(c + ' double' for c in COLS)}").cache(), rows


def test_impact_and_zscore_take_their_moments_in_turns(spark, widths):
    df, rows = _table(spark)
    got = {r["feature"]: r for r in QL.impute_impact(df, df.selectExpr("id", *[f"{c} * 2 AS {c}" for c in COLS]), COLS).collect()}
    assert sorted(got) == sorted(COLS[:11])                 # the last one has no value
    assert all(abs(r["mean_rel_change"]) == pytest.approx(1) and r["std_rel_change"] == pytest.approx(1) and r["alert_large_shift"] == 1 for r in got.values())
    z = np.array([list(r)[1:] for r in PP.zscore_matrix(df, ["id"], COLS[:11]).collect()])
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9) and np.allclose(z.std(axis=0), 1)
    assert widths and max(widths) <= 8


def test_chain_in_long_form_equals_the_wide_one(spark, widths):
    df, _ = _table(spark)
    chain = PC.fit_chain(df, ["id"], COLS, min_pairs=50)
    assert max(widths) <= 8
    chain.steps[0].q_low = chain.steps[0].q_high = None     # without bounds
    out = chain.long(df, ["id"])
    wide = {r["id"]: r for r in chain.transform(df, ["id"]).collect()}
    long = out.collect()
    assert out.columns == ["id", "feature", "value", "is_outlier_hi", "is_outlier_lo"] and len(long) == 400 * len(chain.kept)
    for r in long:
        w, c = wide[r["id"]], r["feature"]
        assert (r["value"], r["is_outlier_hi"], r["is_outlier_lo"]) == (w[c], w[f"is_outlier_hi_{c}"], w[f"is_outlier_lo_{c}"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()    # noqa: SLF001
    assert plan.count("greatest(") <= 2                     # not one expression a feature
