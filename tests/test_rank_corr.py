"""Rank products by packed buckets: ties, many buckets and repeated keys against pandas."""

import numpy as np
import pandas as pd
import pytest

from termlens.operators import prep as PP


@pytest.mark.parametrize("buckets", [None, 7])
def test_rank_correlation_of_rows_that_share_a_key(spark, buckets):
    rnd = np.random.default_rng(3)
    n = 1500
    a = rnd.normal(size=n)
    pdf = pd.DataFrame({"k": "same", "a": a, "b": np.round(a + rnd.normal(size=n), 0), "c": np.where(rnd.random(n) < 0.8, 1.0, a),
                        "d": np.where(rnd.random(n) < 0.4, np.nan, rnd.integers(0, 3, n)), "e": 5.0})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, a double, b double, c double, d double, e double").repartition(5)
    cols = ["a", "b", "c", "d", "e"]
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in PP.spearman_matrix(df, ["k"], cols, buckets=buckets).collect()}
    want = pdf[cols].corr(method="spearman")
    assert len(got) == 10
    for (x, y), (rows, corr) in got.items():
        assert rows == (pdf[x].notna() & pdf[y].notna()).sum()
        assert corr is None if "e" in (x, y) else corr == pytest.approx(want.loc[x, y], abs=1e-9)
