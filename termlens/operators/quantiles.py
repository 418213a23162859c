"""Exact linear-interpolated quantiles without a shuffle of the values.

A mergeable sketch (`percentile_approx`, one wide aggregate) brackets every wanted rank from below and above within a few
`1 / ACCURACY` of the rows. A second scan counts the values below each bracket and keeps only those inside it, which
are counted by value and ordered; the wanted positions are read from them. Without groups that scan compares Arrow batches in numpy. The result equals `percentile` on the same data. What is
shuffled is the sketches and a few ten-thousandths of the cells; groups of at most `ACCURACY` values are ordered whole. Should a
bracket miss its position (the ranks are checked against the counts), the scan is repeated with wider ones, at last with the whole range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlens.functions.nulls import to_number
from termlens.session import stored

ACCURACY = 10_000
MARGINS = (4 / ACCURACY, 64 / ACCURACY, 1.0)


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], by: list[str] | None = None,
                    exprs: dict[str, Column] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(by..., feature, q0, q1, ...): one row per group and feature that has a non-null value."""
    by, exprs = by or [], exprs or {}
    base = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
                     *[exprs.get(c, to_number(c)).cast("double").alias(f"_v{j}") for j, c in enumerate(cols)])
    keys = [f"_k{i}" for i in range(len(by))]
    for margin in MARGINS:
        got = stored(_positions(base, keys, len(cols), qs, margin * ACCURACY / accuracy if margin < 1 else 1.0, accuracy), "quantiles")
        missed = F.lit(False)
        for i in range(len(qs)):
            missed = missed | F.col(f"_lo{i}").isNull() | F.col(f"_hi{i}").isNull()
        if margin == MARGINS[-1] or got.where(missed).isEmpty():
            break
    out = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))).alias(f"q{i}"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_j") + 1).alias("feature")
    return got.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(by)], name, *out)


def _positions(base: DataFrame, keys: list[str], n_cols: int, qs: list[float], margin: float, accuracy: int) -> DataFrame:
    """(keys, _j, _n, _lo0, _hi0, ...): the values around every wanted position; null where a bracket missed it."""
    probes = [p for q in qs for p in (max(0.0, q - margin), min(1.0, q + margin))]
    probe = "array(" + ", ".join(f"double('{p!r}')" for p in probes) + ")"
    sketch = base.groupBy(*keys).agg(*[F.expr(f"count(_v{j})").alias(f"_n{j}") for j in range(n_cols)],
                                     *[F.expr(f"percentile_approx(_v{j}, {probe}, {accuracy})").alias(f"_b{j}") for j in range(n_cols)])
    sketch = stored(sketch, "sketch")
    if keys:
        ranks, kept = _inside(base, sketch, keys, n_cols, qs, margin, accuracy)
    else:
        ranks, kept = _inside_batches(base, sketch.first().asDict(), n_cols, qs, margin, accuracy)
    before = Window.partitionBy(*keys, "_j", "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    rows = _null_safe(kept, ranks, [*keys, "_j", "_i"], "right")
    first = F.col("_u") + F.col("_before")
    at = F.col("_q") * (F.col("_n") - 1)
    picks = []
    for i in range(len(qs)):
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col("_i") == i) & (pos >= first) & (pos < first + F.col("_c")), F.col("_v"))).alias(f"_{side}{i}"))
    return rows.groupBy(*keys, "_j").agg(F.first("_n").alias("_n"), *picks)


def _inside_batches(base: DataFrame, sketch: dict, n_cols: int, qs: list[float], margin: float, accuracy: int) -> tuple[DataFrame, DataFrame]:
    """As `_inside` for the table as one group: its sketch is one row of numbers, every bracket is compared with a whole column."""
    spark = base.sparkSession
    bounds = {}
    for j in range(n_cols):
        whole = margin >= 1.0 or sketch[f"_n{j}"] <= accuracy
        for i in range(len(qs)):
            if sketch[f"_n{j}"]:
                bounds[j, i] = (-np.inf, np.inf) if whole else (sketch[f"_b{j}"][2 * i], sketch[f"_b{j}"][2 * i + 1])

    def scan(batches):
        under = dict.fromkeys(bounds, 0)
        for batch in batches:
            cols = {j: batch.column(j).drop_null().to_numpy(zero_copy_only=False) for j in {j for j, _ in bounds}}
            found = []
            for (j, i), (lo, hi) in bounds.items():
                v = cols[j]
                under[j, i] += int(np.count_nonzero(v < lo))
                values, counts = np.unique(v[(v >= lo) & (v <= hi)] + 0.0, return_counts=True)
                found.append((np.full(len(values), j, np.int32), np.full(len(values), i, np.int32), values, counts.astype(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["_j", "_i", "_v", "_c"])
        yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in under], pa.int32()), pa.array([i for _, i in under], pa.int32()),
                                          pa.nulls(len(under), pa.float64()), pa.array(list(under.values()), pa.int64())], ["_j", "_i", "_v", "_c"])

    # (feature, quantile, value inside, its number); without a value: the number below the bracket
    got = stored(base.mapInArrow(scan, "_j int, _i int, _v double, _c long"), "inside")
    below = {(r["_j"], r["_i"]): r["_c"] for r in got.where("_v IS NULL").groupBy("_j", "_i").agg(F.sum("_c").alias("_c")).collect()}
    ranks = spark.createDataFrame([(j, i, sketch[f"_n{j}"], below.get((j, i), 0), float(qs[i])) for j, i in bounds],
                                  "_j int, _i int, _n long, _u long, _q double")
    return ranks, got.where("_v IS NOT NULL").groupBy("_j", "_i", "_v").agg(F.sum("_c").alias("_c"))


def _inside(base: DataFrame, sketch: DataFrame, keys: list[str], n_cols: int, qs: list[float], margin: float,
            accuracy: int) -> tuple[DataFrame, DataFrame]:
    """(ranks, kept): per group, feature and quantile the rank wanted and the number below its bracket; the values inside."""
    cells = _null_safe(base, sketch, keys)

    # as SQL text: thousands of column objects would cost more than the scans
    pairs = [(j, i) for j in range(n_cols) for i in range(len(qs))]
    whole = "true" if margin >= 1.0 else f"_n{{j}} <= {accuracy}"
    lo = f"IF({whole}, double('-Infinity'), _b{{j}}[{{lo}}])"
    hi = f"IF({whole}, double('Infinity'), _b{{j}}[{{hi}}])"

    def each(text: str, j: int, i: int) -> str:
        return text.format(j=j, i=i, lo=2 * i, hi=2 * i + 1, q=repr(float(qs[i])))

    under = cells.groupBy(*keys).agg(*[F.expr(each(f"count_if(_v{{j}} < {lo})", j, i)).alias(f"_u{j}_{i}") for j, i in pairs])
    ranks = F.expr("array(" + ", ".join(each("named_struct('_j', {j}, '_i', {i}, '_n', _n{j}, '_u', _u{j}_{i}, '_q', double('{q}'))", j, i) for j, i in pairs) + ")")
    inside = F.expr("array_compact(array(" + ", ".join(each(
        f"CASE WHEN _v{{j}} >= {lo} AND _v{{j}} <= {hi} THEN named_struct('_j', {{j}}, '_i', {{i}}, '_v', _v{{j}}) END", j, i) for j, i in pairs) + "))")
    wide = _null_safe(under, sketch, keys)
    ranks = wide.select(*keys, F.explode(ranks).alias("_r")).select(*keys, "_r.*").where("_n > 0")
    kept = cells.select(*keys, F.explode(inside).alias("_c")).select(*keys, "_c.*")
    return ranks, kept.groupBy(*keys, "_j", "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys` in which null equals null; the keys of `left` stay (of `right` in a right join)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    got = left.join(r, cond, how)
    if how == "right":
        got = got.drop(*keys).withColumnsRenamed({f"_r_{k}": k for k in keys})
    return got.drop(*[f"_r_{k}" for k in keys])


def quantile_values(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """{feature: values}; a feature without values has Nones (one row per feature comes to the driver)."""
    got = {r["feature"]: [r[f"q{i}"] for i in range(len(qs))] for r in exact_quantiles(df, cols, qs).collect()}
    return {c: got.get(c, [None] * len(qs)) for c in cols}


def wide_quantiles(df: DataFrame, cols: list[str], q: float, by: list[str], prefix: str) -> DataFrame:
    """(by..., <prefix><col>...): one quantile of every column per group."""
    long = exact_quantiles(df, cols, [q], by)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, F.col("q0"))).alias(f"{prefix}{c}") for c in cols])
