"""Exact quantiles of a whole table: columns are compared in batches, brackets that miss are widened."""

import numpy as np

from termlens.operators import quantiles as Q


def test_whole_table_quantiles_in_batches(spark):
    rng = np.random.default_rng(3)
    n = 6000
    a, b = rng.normal(size=n), rng.integers(0, 4, n).astype(float)
    rows = [(float(a[i]), float(b[i]) if i % 3 else None, None, "nan" if i % 2 else str(i - 0.5)) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d string").repartition(5)
    qs = [0.0, 0.01, 0.5, 0.75, 0.999, 1.0]
    frame = Q.exact_quantiles(df, list("abcd"), qs, accuracy=200)
    plan = frame._jdf.queryExecution().toString()
    got = {r["feature"]: [r[f"q{i}"] for i in range(len(qs))] for r in frame.collect()}
    want = {"a": a, "b": b[np.arange(n) % 3 != 0], "d": np.arange(0, n, 2) - 0.5}
    assert set(got) == set(want) and "Generate" not in plan
    for c, v in want.items():
        np.testing.assert_allclose(got[c], np.quantile(v, qs), rtol=1e-12, atol=1e-12)
    assert hasattr(Q, "_inside_batches")


def test_no_rows(spark):
    assert Q.exact_quantiles(spark.createDataFrame([], "a double"), ["a"], [0.5]).count() == 0


def test_wide_aggregates_in_turns(spark):
    from pyspark.sql import functions as F

    from termlens.operators import prep as PP
    df = spark.range(20).select(*[(F.col("id") % (j + 2)).cast("double").alias(f"c{j}") for j in range(11)])
    aggs = [F.var_pop(c).alias(c) for c in df.columns]
    assert PP._in_turns(df, aggs, 4) == df.agg(*aggs).first().asDict()
