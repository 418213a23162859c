"""Clustering quality on given labels (M1-M8) and cluster explanations.

Geometry metrics use O(n*k) formulas: per-cluster sums (k rows, collected as model-like parameters) are inlined
as literal arrays, so no pairwise distances and no join of points with points are ever formed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlens.config import DIR_HINTS
from termlens.functions.nulls import canonical
from termlens.operators.quantiles import exact_quantiles
from termlens.session import stored

STD_EPS = 1e-12
TOP_N = 10
FEATURES_AT_ONCE = 8
MIXED_NAME = "混合型/需进一步解释"


def _vec(c) -> Column:
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda v: v.cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def cluster_sums(df: DataFrame, vec: str, label: str) -> dict:
    """Per cluster: size, element-wise sum of vectors, sum of squared norms (k x d numbers, collected)."""
    x = df.select(F.col(label).alias("_l"), _vec(vec).alias("_x"))
    ex = x.select("_l", F.posexplode("_x").alias("_i", "_v"))
    dims = ex.groupBy("_l", "_i").agg(F.sum("_v").alias("_s"))
    per = dims.groupBy("_l").agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_a"))
    nrm = x.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"), F.sum(_dot(F.col("_x"), F.col("_x"))).alias("_q"))
    rows = per.join(nrm, "_l").collect()
    return {r["_l"]: (r["_n"], [e["_s"] for e in r["_a"]], r["_q"]) for r in rows}


def silhouette_sq(df: DataFrame, vec: str, label: str) -> DataFrame:
    """M1 (squared Euclidean): a = mean squared distance to the other members of the own cluster,
    b = smallest mean squared distance to another cluster, s = (b - a) / max(a, b), 0 for singletons; mean of s."""
    cs = cluster_sums(df, vec, label)
    labels = sorted(cs)
    x = _vec(vec)
    xx = _dot(x, x)
    mean_d = {}
    for l in labels:
        n, s, q = cs[l]
        sv = F.array(*[F.lit(float(v)) for v in s])
        mean_d[l] = xx + F.lit(q / n) - F.lit(2.0 / n) * _dot(x, sv)      # mean over all members incl. self
    own_n = F.element_at(F.create_map(*[e for l in labels for e in (F.lit(l), F.lit(cs[l][0]))]), F.col(label))
    own_d = F.element_at(F.create_map(*[e for l in labels for e in (F.lit(l), mean_d[l])]), F.col(label))
    a = own_d * own_n / (own_n - 1)
    others = [F.when(F.col(label) != l, mean_d[l]) for l in labels]
    b = F.least(*others) if len(others) > 1 else F.lit(None)
    s = F.when(own_n <= 1, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return df.select(s.alias("s")).agg(F.avg("s").alias("silhouette_sq"))


def calinski_harabasz(df: DataFrame, vec: str, label: str) -> DataFrame:
    """M2: (B / (k - 1)) / (W / (n - k)) with B = sum n_k |c_k - c|^2, W = sum |x - c_label|^2."""
    cs = cluster_sums(df, vec, label)
    labels = sorted(cs)
    n = sum(v[0] for v in cs.values())
    k = len(labels)
    d = len(next(iter(cs.values()))[1])
    g = [sum(cs[l][1][i] for l in labels) / n for i in range(d)]
    B = sum(cs[l][0] * sum((cs[l][1][i] / cs[l][0] - g[i]) ** 2 for i in range(d)) for l in labels)
    cent = F.element_at(F.create_map(*[e for l in labels for e in (
        F.lit(l), F.array(*[F.lit(v / cs[l][0]) for v in cs[l][1]]))]), F.col(label))
    w = df.select(_sqdist(_vec(vec), cent).alias("w")).agg(F.sum("w").alias("W"))
    denom = (k - 1) if k > 1 else None
    return w.select(((F.lit(B) / F.lit(denom)) / (F.col("W") / F.lit(n - k))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, vec: str, label: str) -> DataFrame:
    """M3: mean over clusters of max_j (s_i + s_j) / |c_i - c_j|, s = mean Euclidean distance to the centroid."""
    cs = cluster_sums(df, vec, label)
    labels = sorted(cs)
    cents = {l: [v / cs[l][0] for v in cs[l][1]] for l in labels}
    cent = F.element_at(F.create_map(*[e for l in labels for e in (F.lit(l), F.array(*[F.lit(v) for v in cents[l]]))]),
                        F.col(label))
    s_rows = df.select(F.col(label).alias("l"), F.sqrt(_sqdist(_vec(vec), cent)).alias("d")) \
        .groupBy("l").agg(F.avg("d").alias("s")).collect()
    s = {r["l"]: r["s"] for r in s_rows}
    tot = 0.0
    for i in labels:
        best = 0.0
        for j in labels:
            if i == j:
                continue
            dij = math.sqrt(sum((a - b) ** 2 for a, b in zip(cents[i], cents[j])))
            best = max(best, (s[i] + s[j]) / dij if dij > 0 else float("inf"))
        tot += best
    spark = df.sparkSession
    return spark.createDataFrame([(tot / len(labels),)], "davies_bouldin double")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """M4: chance-adjusted pair agreement from the contingency table (aggregates only; scalars combined)."""
    ct = contingency(df, a, b).cache()
    c2 = lambda x: x * (x - 1) / 2.0
    r = ct.agg(F.sum(c2(F.col("n"))).alias("sij"), F.sum("n").alias("n")).first()
    sa = ct.groupBy("a").agg(F.sum("n").alias("m")).agg(F.sum(c2(F.col("m")))).first()[0]
    sb = ct.groupBy("b").agg(F.sum("n").alias("m")).agg(F.sum(c2(F.col("m")))).first()[0]
    ct.unpersist()
    n = r["n"]
    exp = sa * sb / (n * (n - 1) / 2.0) if n and n > 1 else 0.0
    mx = (sa + sb) / 2.0
    ari = 1.0 if mx == exp else (r["sij"] - exp) / (mx - exp)
    return df.sparkSession.createDataFrame([(float(ari),)], "ari double")


def normalized_mi(df: DataFrame, a: str, b: str) -> DataFrame:
    """M5: mutual information / arithmetic mean of the two entropies (natural log); both entropies 0 -> 1."""
    ct = contingency(df, a, b).cache()
    n = ct.agg(F.sum("n")).first()[0]
    ra = ct.groupBy("a").agg(F.sum("n").alias("na"))
    rb = ct.groupBy("b").agg(F.sum("n").alias("nb"))
    N = F.lit(float(n))
    mi = ct.join(ra, "a").join(rb, "b").agg(
        F.sum(F.col("n") / N * F.log(N * F.col("n") / (F.col("na") * F.col("nb"))))).first()[0]
    ha = ra.agg(-F.sum(F.col("na") / N * F.log(F.col("na") / N))).first()[0]
    hb = rb.agg(-F.sum(F.col("nb") / N * F.log(F.col("nb") / N))).first()[0]
    ct.unpersist()
    den = (ha + hb) / 2.0
    nmi = 1.0 if den <= 0 else mi / den
    return df.sparkSession.createDataFrame([(float(nmi),)], "nmi double")


def prob_l1(df: DataFrame, p: list[str], q: list[str]) -> DataFrame:
    """M6: mean |p - q| over all cells."""
    d = None
    for x, y in zip(p, q):
        t = F.abs(F.col(x) - F.col(y))
        d = t if d is None else d + t
    return df.agg((F.avg(d) / len(p)).alias("prob_mean_l1"))


def prob_jsd(df: DataFrame, p: list[str], q: list[str], eps: float = 1e-12) -> DataFrame:
    """M7: mean Jensen-Shannon divergence, p and q clipped to [eps, 1], natural log."""
    terms = None
    for x, y in zip(p, q):
        px = F.least(F.greatest(F.col(x), F.lit(eps)), F.lit(1.0))
        qy = F.least(F.greatest(F.col(y), F.lit(eps)), F.lit(1.0))
        m = (px + qy) * 0.5
        t = 0.5 * (px * F.log(px / m) + qy * F.log(qy / m))
        terms = t if terms is None else terms + t
    return df.agg(F.avg(terms).alias("prob_mean_jsd"))


def pmax_quantiles(df: DataFrame, pmax: str = "mode_pmax") -> DataFrame:
    """M8: mean, p10, p50, p90 of p_max (linear percentiles)."""
    q = exact_quantiles(df, [pmax], [0.1, 0.5, 0.9])
    return df.agg(F.avg(pmax).alias("pmax_mean")).withColumn("feature", F.lit(pmax)).join(q, "feature", "left").select(
        "pmax_mean", F.col("q0").alias("pmax_p10"), F.col("q1").alias("pmax_p50"), F.col("q2").alias("pmax_p90"))


# ---- E1-E3 ----

def direction_hint(feature: Column, z: Column, hints: dict[str, tuple[str, str]] = DIR_HINTS) -> Column:
    """(feature, sign of z) -> hint text of the table `hints`; unknown feature -> null."""
    hi = F.create_map(*[e for f, (h, _) in hints.items() for e in (F.lit(f), F.lit(h))])
    lo = F.create_map(*[e for f, (_, l) in hints.items() for e in (F.lit(f), F.lit(l))])
    f = F.lower(feature)
    return F.when(z > 0, F.element_at(hi, f)).otherwise(F.element_at(lo, f))


def _long_means(x: DataFrame, features: list[str], at: int) -> DataFrame:
    """Cluster mean, parent mean and parent sd of `FEATURES_AT_ONCE` features from number `at` on, one row a cluster and feature."""
    part = list(enumerate(features))[at:at + FEATURES_AT_ONCE]
    cm = x.groupBy("_p", "cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"), *[F.avg(c).alias(c) for _, c in part])
    om = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_tot"), *[F.avg(c).alias(f"m_{c}") for _, c in part],
                             *[F.stddev_pop(c).alias(f"s_{c}") for _, c in part])
    j = cm.join(om, "_p", "inner")        # om has one row per parent (<= number of modes)
    r = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(c).alias("mean_cluster"),
                                     F.col(f"m_{c}").alias("mean_overall"), F.col(f"s_{c}").alias("sd")) for i, c in part])).alias("r")
    return j.select("_p", "cluster_id", "cluster_size", (F.col("cluster_size") / F.col("_tot")).alias("cluster_pct"), r) \
        .select("_p", "cluster_id", "cluster_size", "cluster_pct", "r.*")


def cluster_top_features(df: DataFrame, label: str, features: list[str], parent: str | None = None,
                         top_n: int = TOP_N, hints: dict[str, tuple[str, str]] = DIR_HINTS) -> DataFrame:
    """E1 (parent=None): z of each cluster mean against the overall mean and population sd; E2 (parent=mode):
    against the parent's mean and sd. +-inf / null z -> 0; top `top_n` by |z| per cluster (feature order breaks
    ties); direction and hint (P24). Labels and features are written once and aggregated some features a scan: generated code
    for all at once is too long to be compiled by the JVM."""
    x = stored(df.select((F.col(parent) if parent else F.lit(0)).alias("_p"), F.col(label).alias("cluster_id"),
                         *[F.col(c).cast("double").alias(c) for c in features]), "features")
    long = reduce(DataFrame.unionByName, [_long_means(x, features, at) for at in range(0, len(features), FEATURES_AT_ONCE)])
    pk = ["_p"]          # unparented: one constant parent, so the overall row joins on an equality key
    sd_safe = F.when(F.col("sd").isNull() | F.isnan("sd") | (F.col("sd") <= STD_EPS), F.lit(1.0)).otherwise(F.col("sd"))
    z = (F.col("mean_cluster") - F.col("mean_overall")) / sd_safe
    z = F.when(z.isNull() | F.isnan(z), F.lit(0.0)).otherwise(z)
    long = long.select("*", z.alias("z"), sd_safe.alias("std_overall"))
    # <= p rows per cluster; |z| compared at 1e-9 so float noise cannot reorder equal features
    w = Window.partitionBy(*pk, "cluster_id").orderBy(F.desc(canonical(F.abs("z"))), "pos")
    top = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    out = top.select(*(F.col("_p").alias(parent),) if parent else (), "cluster_id", "cluster_size", "cluster_pct", "feature",
                     "z", F.abs("z").alias("abs_z"), F.when(F.col("z") > 0, F.lit("高")).otherwise(F.lit("低"))
                     .alias("direction_vs_overall"), "mean_cluster", "mean_overall", "std_overall",
                     direction_hint(F.col("feature"), F.col("z"), hints).alias("interpretation_hint"), "rank")
    return out


def cluster_name_draft(top: DataFrame, parent: str | None = None) -> DataFrame:
    """First three distinct hints in |z| order joined by '、', else the mixed-type name."""
    pk = [parent] if parent else []
    g = top.groupBy(*pk, "cluster_id", "cluster_size", "cluster_pct").agg(
        F.array_sort(F.collect_list(F.struct("rank", "interpretation_hint"))).alias("_h"))     # <= top_n per cluster
    hints = F.array_distinct(F.filter(F.transform("_h", lambda e: e["interpretation_hint"]), lambda h: h.isNotNull()))
    return g.select(*pk, "cluster_id", "cluster_size", "cluster_pct",
                    F.when(F.size(hints) == 0, F.lit(MIXED_NAME)).otherwise(F.array_join(F.slice(hints, 1, 3), "、"))
                    .alias("name_draft"))
