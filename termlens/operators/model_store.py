"""Mixtures as stored tables, and their posterior as JVM expressions.

A model is one row a component: weight, mean, upper factor of the inverse covariance, log-determinant. Scoring reads these k rows and
needs no fit: the posterior is a log-sum-exp over k closed expressions, inside whole-stage code.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.operators import scores as S
from termlens.operators.mixture import LOG_2PI, Mixture

SCHEMA = "component int, weight double, log_det double, mean array<double>, factor array<array<double>>"


def save_mixture(spark: SparkSession, model: Mixture, path: str) -> None:
    rows = [(i, float(w), float(ld), m.tolist(), f.tolist()) for i, (w, ld, m, f) in
            enumerate(zip(model.weights, model.log_dets, model.means, model.factors))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("errorifexists").parquet(path)


def load_mixture(spark: SparkSession, path: str) -> Mixture:
    rows = spark.read.schema(SCHEMA).parquet(path).orderBy("component").collect()          # k rows
    return Mixture(np.array([r["weight"] for r in rows]), np.array([r["mean"] for r in rows]), np.array([r["factor"] for r in rows]))


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def posterior_columns(df: DataFrame, cols: list[str], model: Mixture, names: list[str], keep: list[str]) -> DataFrame:
    """`keep` and one posterior column a component. A row with a missing feature has null posteriors."""
    d = len(cols)
    z = []
    for i in range(model.k):
        ys = [_sum([(F.col(cols[r]).cast("double") - F.lit(float(model.means[i, r]))) * F.lit(float(model.factors[i, r, c])) for r in range(c + 1)])
              for c in range(d)]
        const = math.log(model.weights[i]) + float(model.log_dets[i]) - 0.5 * d * LOG_2PI
        z.append((F.lit(const) - F.lit(0.5) * _sum([y * y for y in ys])).alias(f"_z{i}"))
    zs = [F.col(f"_z{i}") for i in range(model.k)]
    whole = F.lit(True)
    for c in zs:
        whole = whole & c.isNotNull()
    top = F.greatest(*zs) if len(zs) > 1 else zs[0]
    scored = df.select(*keep, *z).select(*keep, *[F.when(whole, F.exp(c - top)).alias(f"_e{i}") for i, c in enumerate(zs)])
    es = [F.col(f"_e{i}") for i in range(model.k)]
    return scored.select(*keep, *[(e / _sum(es)).alias(n) for e, n in zip(es, names)])


def soft_assignment(df: DataFrame, cols: list[str], model: Mixture, keys: list[str], prefix: str = "cluster") -> DataFrame:
    """keys, hard label (first on ties), p_<prefix>_i, p_max, p_second, margin, entropy."""
    names = [f"p_{prefix}_{i}" for i in range(model.k)]
    p = S.p_array(names)
    return posterior_columns(df, cols, model, names, keys).select(
        *keys, S.hard_label(p).alias(f"{prefix}_map"), *names, S.pmax(p).alias("p_max"), S.psecond(p).alias("p_second"),
        (S.pmax(p) - S.psecond(p)).alias("margin"), S.entropy(p).alias("entropy"))
