"""Feature preparation: imputation, winsorising, scaling, pruning, outlier flags, rank correlation, PCA
(X1-X14, W1-W3, U1-U4).

Fit steps are one wide aggregate each (collected: O(features)); transforms are single projections with the
parameters inlined. Per-entity / per-period statistics are aggregates joined back on their key (the join lets
AQE split a skewed key; a window would put a whole hot key into one task).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlens.functions.nulls import canonical, to_number
from termlens.operators.quantiles import quantile_values, wide_quantiles
from termlens.operators.rank_corr import rank_products
from termlens.session import stored

# Fixed values of the preparation rules.
P_LOW, P_HIGH = 0.01, 0.99
VAR_EPS = 1e-8
SD_EPS = 1e-12
CORR_THRESH = 0.90
MIN_PAIRS = 500
PARSE_MIN = 0.5
HIGH_MISSING = 0.60


def _pct_fit(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    return quantile_values(df, cols, qs)


def _lit(v) -> Column:
    return F.lit(v).cast("double")


def _in_turns(df: DataFrame, aggs: list[Column], width: int = 8) -> dict:
    """One row of global aggregates, `width` of them in a scan: generated code for all of a wide table at once is too long to be
    compiled by the JVM (40 to 50 microseconds a row for 39 variances)."""
    got: dict = {}
    for i in range(0, len(aggs), width):
        got.update(df.agg(*aggs[i:i + width]).first().asDict())
    return got


# ---- X1: global median fill ----

def median_fit(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantile_values(df, cols, [0.5]).items()}


def median_impute(df: DataFrame, keys: list[str], cols: list[str], flags: bool = True) -> DataFrame:
    """X1 (+ P13): fill each feature with its global median; optional `is_missing_*` flags."""
    med = median_fit(df, cols)
    out = [F.coalesce(to_number(c), _lit(med[c])).alias(c) for c in cols]
    fl = [to_number(c).isNull().cast("int").alias(f"is_missing_{c}") for c in cols] if flags else []
    return df.select(*keys, *out, *fl)


# ---- X2 / X3: tiered imputation (entity median -> period median -> global median -> 0) ----

@dataclass
class TieredResult:
    data: DataFrame
    imputed: list[str]
    make_log: Callable[[], DataFrame]

    @cached_property
    def log(self) -> DataFrame:
        """One row a feature; counted only when asked for."""
        return self.make_log()


LOG_SCHEMA = ("feature string, missing_rate double, numeric_parse_rate double, imputed_total long, from_xh_median long, "
              "from_term_median long, from_global_median long, high_missing_feature int, note string")


def _rates(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = _in_turns(df, [F.avg(x.cast("double")).alias(f"{p}__{c}") for c in cols
                         for p, x in (("m", to_number(c).isNull()), ("p", to_number(c).isNotNull()))])
    return {c: (row[f"m__{c}"], row[f"p__{c}"]) for c in cols}


def tiered_impute(df: DataFrame, entity: str, period: str, cols: list[str], only: list[str] | None = None,
                  parse_min: float = PARSE_MIN) -> TieredResult:
    """For numeric features (parse rate >= .5, Q4) fill from the entity median, then the period median of the
    partly filled column (Q5), then the global median of that, else 0; `is_missing_*` for every feature and a
    per-feature log (A32). `only` restricts filling to a whitelist (X3)."""
    rates = _rates(df, cols)
    fill = [c for c in cols if rates[c][1] >= parse_min and (only is None or c in only)]
    flags = [f"is_missing_{c}" for c in cols]
    rest = [c for c in cols if c not in fill]

    def log(used: dict[str, list[int]]) -> DataFrame:
        rows = []
        for c in cols:
            mr, pr = rates[c]
            u = used.get(c, [0, 0, 0])
            note = "ok" if c in fill else "skip_non_numeric_feature" if pr < parse_min else "not_in_whitelist"
            rows.append((c, mr, pr, sum(u), *u, int(mr > HIGH_MISSING), note))
        return df.sparkSession.createDataFrame(rows, LOG_SCHEMA)

    base = df.select(entity, period, *[to_number(c).alias(c) if c in fill else F.col(c) for c in cols],
                     *[to_number(c).isNull().cast("int").alias(f) for c, f in zip(cols, flags)])
    if not fill:
        return TieredResult(base, [], lambda: log({}))
    # tier 1: entity medians (aggregate, joined back null-safe on the key); stored, since two scans and the next tier read it
    em = base.groupBy(F.col(entity).alias("_e")).agg(*[F.median(c).alias(f"_em_{c}") for c in fill])
    w1 = base.join(em, F.col(entity).eqNullSafe(F.col("_e")), "left")
    w1 = stored(w1.select(entity, period, *rest, *flags, *[F.coalesce(F.col(c), F.col(f"_em_{c}")).alias(c) for c in fill],
                          *[(F.col(c).isNull() & F.col(f"_em_{c}").isNotNull()).cast("int").alias(f"_u1_{c}") for c in fill]), "tier1")
    # tier 2: period medians of the tier-1 result
    pm = wide_quantiles(w1, fill, 0.5, [period], "_pm_").withColumnRenamed(period, "_pp")
    w2 = w1.join(pm, F.col(period).eqNullSafe(F.col("_pp")), "left")
    w2 = stored(w2.select(entity, period, *rest, *flags, *[f"_u1_{c}" for c in fill],
                          *[F.coalesce(F.col(c), F.col(f"_pm_{c}")).alias(c) for c in fill],
                          *[(F.col(c).isNull() & F.col(f"_pm_{c}").isNotNull()).cast("int").alias(f"_u2_{c}") for c in fill]), "tier2")
    # tier 3: global median, inlined
    gm = median_fit(w2, fill)
    data = w2.select(entity, period, *[F.coalesce(F.col(c), _lit(gm[c] if gm[c] is not None else 0.0)).alias(c) if c in fill else F.col(c)
                                       for c in cols], *flags)

    def counted() -> DataFrame:
        got = w2.agg(*[F.sum(f"_u{t}_{c}").alias(f"{c}__u{t}") for c in fill for t in (1, 2)], *[F.count_if(F.col(c).isNull()).alias(f"{c}__u3") for c in fill]).first()
        return log({c: [int(got[f"{c}__u{t}"] or 0) for t in (1, 2, 3)] for c in fill})

    return TieredResult(data, fill, counted)


# ---- W1: partition median broadcast back to rows ----

def partition_median(df: DataFrame, key: str, col: str, alias: str) -> DataFrame:
    """Median of `col` per `key`, attached to each row (aggregate + null-safe join; AQE splits hot keys)."""
    m = df.groupBy(key).agg(F.median(col).alias(alias))
    return df.join(m, df[key].eqNullSafe(m[key]), "left").drop(m[key])


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Keep the first row per key under a total order of ascending columns (one aggregate, no sort)."""
    cols = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


# ---- X4 / X5: winsorise and robust scale ----

def winsorize_fit(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    q = _pct_fit(df, cols, [P_LOW, P_HIGH])
    return {c: tuple(q[c]) for c in cols}


def clip_expr(c: str, lo, hi) -> Column:
    x = to_number(c)
    if lo is None:
        return x
    return F.when(x.isNull(), _lit(None)).otherwise(F.least(F.greatest(x, _lit(lo)), _lit(hi)))


def winsorize(df: DataFrame, keys: list[str], cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Clip every feature to its [p01, p99] (linear percentiles)."""
    p = winsorize_fit(df, cols)
    return df.select(*keys, *[clip_expr(c, *p[c]).alias(c) for c in cols], *(keep or []))


def robust_scale(df: DataFrame, keys: list[str], cols: list[str], keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """X4 + X5: winsorise, then (x - median) / IQR of the clipped data (IQR 0 -> 1). Returns (scaled, params)
    where params is the small table persisted for scoring (S10)."""
    w = winsorize_fit(df, cols)
    clipped = df.select(*keys, *[clip_expr(c, *w[c]).alias(c) for c in cols], *(keep or []))
    q = _pct_fit(clipped, cols, [0.25, 0.5, 0.75])
    out, rows = [], []
    for c in cols:
        q1, med, q3 = q[c]
        iqr = None if q1 is None else (q3 - q1)
        iqr = 1.0 if (iqr is None or iqr == 0) else iqr
        out.append(((F.col(c) - _lit(med)) / _lit(iqr)).alias(c))
        rows.append((c, w[c][0], w[c][1], med, iqr))
    params = df.sparkSession.createDataFrame(rows, "feature string, q_low double, q_high double, median double, iqr double")
    return clipped.select(*keys, *out, *(keep or [])), params


def drop_low_variance(df: DataFrame, cols: list[str], eps: float = VAR_EPS) -> DataFrame:
    """X6 report: population variance after a median fill; `is_dropped` when <= 1e-8."""
    med = median_fit(df, cols)
    row = _in_turns(df, [F.var_pop(F.coalesce(to_number(c), _lit(med[c]))).alias(c) for c in cols])
    rows = [(c, row[c], bool(row[c] is not None and row[c] <= eps)) for c in cols]
    return df.sparkSession.createDataFrame(rows, "feature string, variance double, is_dropped boolean")


def equalize_variance(df: DataFrame, keys: list[str], cols: list[str], eps: float = SD_EPS) -> DataFrame:
    """X / population sd (sd <= 1e-12 -> 1), not centred."""
    row = _in_turns(df, [F.stddev_pop(to_number(c)).alias(c) for c in cols])
    sd = {c: (1.0 if row[c] is None or row[c] <= eps else row[c]) for c in cols}
    return df.select(*keys, *[(to_number(c) / _lit(sd[c])).alias(c) for c in cols])


def flag_outliers(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """`is_outlier_hi_*` strictly above p99, `is_outlier_lo_*` strictly below p01 (missing -> 0)."""
    q = _pct_fit(df, cols, [P_LOW, P_HIGH])
    fl = []
    for c in cols:
        lo, hi = q[c]
        x = to_number(c)
        fl += [F.coalesce((x > _lit(hi)).cast("int"), F.lit(0)).alias(f"is_outlier_hi_{c}"),
               F.coalesce((x < _lit(lo)).cast("int"), F.lit(0)).alias(f"is_outlier_lo_{c}")]
    return df.select(*keys, *cols, *fl)


def zscore_matrix(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(x - mean) / population sd, sd 0 -> 1 (after a median fill, as in the screening step)."""
    filled = median_impute(df, keys, cols, flags=False)
    row = _in_turns(filled, [f(c).alias(f"{tag}_{c}") for c in cols for tag, f in (("m", F.avg), ("s", F.stddev_pop))])
    sd = {c: (row[f"s_{c}"] if row[f"s_{c}"] else 1.0) for c in cols}
    return filled.select(*keys, *[((F.col(c) - _lit(row[f"m_{c}"])) / _lit(sd[c])).alias(c) for c in cols])


# ---- X9: pairwise-complete Spearman ----

def average_rank(long: DataFrame, group_cols: list[str], value: str = "value", buckets: int | None = None) -> DataFrame:
    """Average rank (ties share the mean position) of `value` within each group, fully distributed:
    distinct values are counted, cut into ~equal buckets by approximate quantiles, bucket totals are
    prefix-summed per group (<= `buckets` rows per group) and values prefix-summed inside their bucket.
    Returns (group_cols..., value, rank)."""
    vc = long.groupBy(*group_cols, value).agg(F.count(F.lit(1)).alias("_c"))
    if buckets is None:                       # about 50,000 distinct values a bucket
        most = vc.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        buckets = max(1, min(4096, -(-most // 50_000)))
    if buckets == 1:
        wv = Window.partitionBy(*group_cols).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return vc.select(*group_cols, value, (F.coalesce(F.sum("_c").over(wv), F.lit(0)) + (F.col("_c") + 1) / 2.0).alias("rank"))
    qs = [i / buckets for i in range(1, buckets)]
    bounds = vc.groupBy(*group_cols).agg(F.percentile_approx(value, qs, 10000).alias("_b"))
    vb = vc.join(bounds, group_cols).select(*group_cols, value, "_c",
                                             F.size(F.filter("_b", lambda x: x < F.col(value))).alias("_bk"))
    bt = vb.groupBy(*group_cols, "_bk").agg(F.sum("_c").alias("_bc"))
    wg = Window.partitionBy(*group_cols).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*group_cols, "_bk", F.coalesce(F.sum("_bc").over(wg), F.lit(0)).alias("_before_bucket"))
    wb = Window.partitionBy(*group_cols, "_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    r = vb.join(bt, group_cols + ["_bk"]).select(
        *group_cols, value,
        (F.col("_before_bucket") + F.coalesce(F.sum("_c").over(wb), F.lit(0)) + (F.col("_c") + 1) / 2.0).alias("rank"))
    return r


def spearman_matrix(df: DataFrame, keys: list[str], cols: list[str], min_pairs: int = MIN_PAIRS,
                    buckets: int | None = None) -> DataFrame:
    """X9 (long form: a, b, n, corr): pairwise-complete Spearman with average ranks; null when < 500 pairs.
    Columns are grouped by null pattern; every pattern pair is ranked once on its complete rows; all its column pairs come
    from one matrix product of the centred ranks (`rank_corr.py`)."""
    x = df.select(*[canonical(to_number(c)).alias(c) for c in cols])
    # rows by null pattern: as many rows as the table has patterns
    bits = F.concat(*[F.col(c).isNotNull().cast("int").cast("string") for c in cols]).alias("bits")
    found = {r["bits"]: r["count"] for r in x.groupBy(bits).count().collect()}
    pats: dict[tuple, list[str]] = {}
    for i, c in enumerate(cols):
        pats.setdefault(tuple(p[i] for p in found), []).append(c)
    at = {c: i for i, c in enumerate(cols)}
    plist = list(pats.values())
    groups = []
    for i in range(len(plist)):
        for j in range(i, len(plist)):
            groups.append((i, j, plist[i] if i == j else plist[i] + plist[j]))
    both = [tuple(p[at[plist[i][0]]] == "1" and p[at[plist[j][0]]] == "1" for p in found) for i, j, _ in groups]
    n_of = [sum(n for n, on in zip(found.values(), b) if on) for b in both]
    # pattern groups whose complete rows coincide share one ranking; a group with fewer rows than min_pairs can only give null
    # correlations and is never ranked
    first: dict[tuple, int] = {}
    sid_of = {g: first.setdefault(both[g], g) for g in range(len(groups)) if n_of[g] >= max(1, min_pairs)}
    need: dict[int, tuple[list[str], list[str]]] = {}
    for g, s in sid_of.items():
        i, j, _ = groups[s]
        feats = need.setdefault(s, ([plist[i][0], plist[j][0]], []))[1]
        feats += [c for c in groups[g][2] if c not in feats]
    got = rank_products(x, cols, found, need, buckets) if need else {}
    rows = []
    for g, (i, j, gcols) in enumerate(groups):
        for k, a in enumerate(gcols):
            for b in gcols[k + 1:]:
                if i != j and (a in plist[i]) == (b in plist[i]):
                    continue            # pairs inside one pattern are handled by that pattern's own group
                corr = None
                if g in sid_of:
                    m, feats = got[sid_of[g]], need[sid_of[g]][1]
                    u, v = sorted((feats.index(a), feats.index(b)))
                    spread = m[u, u] * m[v, v]
                    corr = float(m[u, v] / spread ** 0.5) if spread > 0 else None
                rows.append((a, b, int(n_of[g]), corr))
    pos = F.create_map(*[v for i, c in enumerate(cols) for v in (F.lit(c), F.lit(i))])
    return _orient(df.sparkSession.createDataFrame(rows, "a string, b string, n long, corr double"), pos, min_pairs)


def _orient(res: DataFrame, pos: Column, min_pairs: int) -> DataFrame:
    """(a, b) in column order; correlation kept only with >= min_pairs complete pairs and a finite value."""
    swap = F.element_at(pos, F.col("a")) > F.element_at(pos, F.col("b"))
    ok = (F.col("n") >= min_pairs) & F.col("corr").isNotNull() & ~F.isnan(F.col("corr"))
    return res.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
                      F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "n",
                      F.when(ok, F.col("corr")).alias("corr"))


def prune_redundant(corr_long: DataFrame, cols: list[str], thresh: float = CORR_THRESH) -> DataFrame:
    """For every pair (i < j in column order) with |rho| > .90 drop `_median` over `_mean`, else the later
    column; every pair counts even when a member is already dropped."""
    order = {c: i for i, c in enumerate(cols)}
    pos = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(order[c]))])
    d = corr_long.where(F.col("corr").isNotNull() & (F.abs(F.col("corr")) > thresh))
    first = F.when(F.element_at(pos, F.col("a")) < F.element_at(pos, F.col("b")), F.col("a")).otherwise(F.col("b"))
    second = F.when(F.element_at(pos, F.col("a")) < F.element_at(pos, F.col("b")), F.col("b")).otherwise(F.col("a"))
    d = d.select(first.alias("a"), second.alias("b"), "corr")
    la, lb = F.lower(F.col("a")), F.lower(F.col("b"))
    drop = (F.when(la.endswith("_median") & lb.endswith("_mean"), F.col("a"))
            .when(lb.endswith("_median") & la.endswith("_mean"), F.col("b")).otherwise(F.col("b")))
    return d.select("a", "b", "corr", drop.alias("drop"))


# ---- X11 / X12: PCA ----

def pca_fit(df: DataFrame, cols: list[str], k: int = 20):
    """X11: standardised features -> ml PCA; returns (model, explained-variance table with cumulative sum W3)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    va = VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="error")
    v = va.transform(df.select(*cols))
    k = min(k, len(cols))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(v)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    spark = df.sparkSession
    t = spark.createDataFrame([(i + 1, e) for i, e in enumerate(ev)], "component int, explained_ratio double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)   # <= 20 rows
    return model, t.withColumn("cumulative_ratio", F.sum("explained_ratio").over(w))


def pca_project(df: DataFrame, keys: list[str], cols: list[str], k: int = 2) -> DataFrame:
    """Centre (Spark PCA does not), project to k components, fix each sign by its largest loading."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    cen = df.select(*keys, *[(F.col(c) - _lit(means[c])).alias(c) for c in cols])
    v = VectorAssembler(inputCols=cols, outputCol="_v").transform(cen)
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(v)
    pcm = model.pc.toArray()
    signs = [1.0 if pcm[abs(pcm[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(v).select(*keys, vector_to_array("_pc").alias("_a"))
    return out.select(*keys, *[(F.col("_a")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)])


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Seeded sample of n rows, stable across partitioning: smallest xxhash64(keys, seed) (top-k: each
    partition keeps n rows before the final merge)."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)
