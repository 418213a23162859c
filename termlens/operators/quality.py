"""Data-quality reports.

Per-feature moments are ONE wide aggregate over the mart (one partial row per task is shuffled), turned into long form
afterwards with `stack` on the single result row. Quantiles and distinct counts need the values: they are unpivoted and
combined map-side by (feature, value) before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlens.functions.nulls import canonical, is_missing_value, to_number
from termlens.operators.prep import _in_turns
from termlens.operators.quantiles import exact_quantiles, quantile_values
from termlens.operators.serving import safe_rel_change

# Thresholds of the audit rules.
HIGH_MISSING = 0.60
WL_MISS_MAX, WL_PARSE_MIN, WL_UNIQUE_MIN = 0.40, 0.95, 20
ALERT_SHIFT = 0.20
MIN_COMPARE = 10
KEEP_MISSING_MAX = 0.6


def _stack(row_df: DataFrame, features: list[str], fields: list[str], prefix_fmt: str = "{c}__{f}") -> DataFrame:
    """Long form (feature, field...) from a one-row wide frame via `stack`."""
    args = ", ".join(f"'{c}', " + ", ".join(f"`{prefix_fmt.format(f=f, c=c)}`" for f in fields) for c in features)
    return row_df.selectExpr(f"stack({len(features)}, {args}) AS (feature, {', '.join(fields)})")


def feature_ranges(mart: DataFrame, features: list[str]) -> DataFrame:
    """Per feature missing rate, zero rate (missing counts as zero, N8), min, p50, mean, p95, p99, max."""
    aggs = []
    for c in features:
        x = to_number(c)
        aggs += [F.avg(x.isNull().cast("double")).alias(f"{c}__missing_rate"),
                 F.avg((F.coalesce(x, F.lit(0.0)) == 0).cast("double")).alias(f"{c}__zero_rate"),
                 F.min(x).alias(f"{c}__min"), F.avg(x).alias(f"{c}__mean"), F.max(x).alias(f"{c}__max")]
    flat = _stack(mart.agg(*aggs), features, ["missing_rate", "zero_rate", "min", "mean", "max"])
    q = exact_quantiles(mart, features, [0.5, 0.95, 0.99]).select("feature", F.col("q0").alias("p50"), F.col("q1").alias("p95"),
                                                                  F.col("q2").alias("p99"))
    return flat.join(q, "feature", "left").select("feature", "missing_rate", "zero_rate", "min", "p50", "mean", "p95", "p99", "max")


def missing_audit(mart: DataFrame, features: list[str]) -> DataFrame:
    """Per feature dtype, n, missing, parseable, distinct non-null values."""
    types = dict(mart.dtypes)
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for c in features:
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"n_missing__{c}"),
                 F.count(to_number(c)).alias(f"n_parse__{c}")]
    wide = mart.agg(*aggs)
    sel = [F.col("n_total")]
    for c in features:
        sel += [F.lit(types[c]).alias(f"{c}__dtype"), F.col("n_total").alias(f"{c}__n_total"),
                F.col(f"n_missing__{c}").alias(f"{c}__n_missing"),
                (F.col(f"n_missing__{c}") / F.col("n_total")).alias(f"{c}__missing_rate"),
                F.col(f"n_parse__{c}").alias(f"{c}__n_numeric_parseable"),
                (F.col(f"n_parse__{c}") / F.col("n_total")).alias(f"{c}__numeric_parse_rate")]
    flat = _stack(wide.select(*sel), features, ["dtype", "n_total", "n_missing", "missing_rate", "n_numeric_parseable",
                                                "numeric_parse_rate"])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), canonical(c).alias("value")) for c in features])
    values = mart.select(F.explode(cells).alias("_r")).select("_r.feature", "_r.value").where("value IS NOT NULL").distinct()
    n = values.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique_nonnull"))
    return flat.join(n, "feature", "left").withColumn("n_unique_nonnull", F.coalesce("n_unique_nonnull", F.lit(0).cast("long")))


def audit_summary(audit: DataFrame, n_rows: Column | int, n_cols_total: int) -> DataFrame:
    """Rows, columns, mean missing rate, columns over 40 % / 60 % missing."""
    return audit.agg(F.max("n_total").alias("n_rows"), F.lit(n_cols_total).alias("n_cols_total"),
                     F.count(F.lit(1)).alias("n_feature_cols"),
                     F.coalesce(F.avg("missing_rate"), F.lit(0.0)).alias("avg_missing_rate"),
                     F.count_if(F.col("missing_rate") > 0.40).alias("feature_missing_gt_40pct"),
                     F.count_if(F.col("missing_rate") > 0.60).alias("feature_missing_gt_60pct"))


def whitelist_rule(audit: DataFrame, miss_max: float = WL_MISS_MAX, parse_min: float = WL_PARSE_MIN,
                   unique_min: int = WL_UNIQUE_MIN) -> DataFrame:
    """0 < missing <= .40, parse >= .95, distinct >= 20 (Q3: both thresholds exposed)."""
    return audit.where((F.col("missing_rate") > 0) & (F.col("missing_rate") <= miss_max)
                       & (F.col("numeric_parse_rate") >= parse_min) & (F.col("n_unique_nonnull") >= unique_min))


def missing_rates(mart: DataFrame, features: list[str]) -> DataFrame:
    """(feature, missing_rate) in one plain aggregate."""
    return _stack(mart.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__missing_rate") for c in features]), features, ["missing_rate"])


def keep_low_missing(audit: DataFrame, max_missing: float = KEEP_MISSING_MAX) -> DataFrame:
    """features with missing rate <= 0.6 (of an audit or of `missing_rates`)."""
    return audit.where(F.col("missing_rate") <= max_missing).select("feature", "missing_rate")


def missing_flags(mart: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """`is_missing_<c>` 0/1 for every feature in one select."""
    return mart.select(*keys, *[to_number(c).isNull().cast("int").alias(f"is_missing_{c}") for c in features])


def missing_value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """P12 report: rows counted missing (null, blank or `nan` text) per column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(is_missing_value(c).cast("long")).alias(f"{c}__n_missing") for c in cols])
    row = row.select(*[F.col("n").alias(f"{c}__n_total") for c in cols], *[f"{c}__n_missing" for c in cols])
    return _stack(row, cols, ["n_total", "n_missing"])


def outlier_summary(scaled: DataFrame, features: list[str]) -> DataFrame:
    """Per feature p01, p99, share strictly above p99 and strictly below p01 (two passes: quantiles, rates)."""
    q = quantile_values(scaled, features, [0.01, 0.99])
    aggs = []
    for c in features:
        lo, hi = q[c]
        x = F.col(c)
        aggs += [F.lit(lo).cast("double").alias(f"{c}__p01"), F.lit(hi).cast("double").alias(f"{c}__p99"),
                 F.avg(F.coalesce((x > F.lit(hi)).cast("double"), F.lit(0.0))).alias(f"{c}__hi_rate"),
                 F.avg(F.coalesce((x < F.lit(lo)).cast("double"), F.lit(0.0))).alias(f"{c}__lo_rate")]
    return _stack(scaled.agg(*aggs), features, ["p01", "p99", "hi_rate", "lo_rate"])


def _moments(df: DataFrame, features: list[str], tag: str) -> DataFrame:
    row = _in_turns(df, [f(to_number(c)).alias(f"{c}__{m}") for c in features for m, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))])
    flat = df.sparkSession.createDataFrame([(c, *(row[f"{c}__{m}"] for m in ("n", "mean", "std"))) for c in features],
                                           f"feature string, {tag}_n long, {tag}_mean double, {tag}_std double")
    q = exact_quantiles(df, features, [0.5, 0.9]).select("feature", F.col("q0").alias(f"{tag}_med"), F.col("q1").alias(f"{tag}_p90"))
    return flat.join(q, "feature", "left")


def impute_impact(before: DataFrame, after: DataFrame, features: list[str], alert: float = ALERT_SHIFT) -> DataFrame:
    """Relative change of mean, population std, median and p90 per feature; alert when any |change| > 0.20.
    Features with < 10 non-null values on either side are skipped."""
    j = _moments(before, features, "b").join(_moments(after, features, "a"), "feature")
    j = j.where((F.col("b_n") >= MIN_COMPARE) & (F.col("a_n") >= MIN_COMPARE))
    d = j.select("feature", *[safe_rel_change(F.col(f"b_{m}"), F.col(f"a_{m}")).alias(f"{n}_rel_change")
                              for m, n in (("mean", "mean"), ("std", "std"), ("med", "median"), ("p90", "p90"))])
    mx = F.greatest(*[F.abs(F.col(f"{n}_rel_change")) for n in ("mean", "std", "median", "p90")])
    return d.select("*", mx.alias("max_abs_rel_change"), (mx > alert).cast("int").alias("alert_large_shift"))


def best_cells(df: DataFrame, keys: list[str], features: list[str], k: int) -> DataFrame:
    """(keys..., feature, value): of every task's rows the k first of each feature by value descending, then keys ascending, so that
    `top_k_per_group` need not order all cells. A task holds a batch and k rows a feature."""
    x = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features])
    schema = df.select(*keys).schema.add("feature", "string").add("value", "double")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        order = [("value", "descending"), *[(c, "ascending") for c in keys]]
        best: dict[str, pa.Table] = {}
        for b in batches:
            for c in features:
                v = b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
                there = np.flatnonzero(np.asarray(b.column(c).is_valid()))
                v = np.where(np.isnan(v[there]), np.inf, v[there])               # NaN is greatest
                held = best.get(c)
                if len(v) > k:
                    there = there[v >= np.partition(v, len(v) - k)[len(v) - k]]
                if not len(there):
                    continue
                mine = pa.Table.from_batches([b.select([*keys, c]).take(pa.array(there))]).rename_columns([*keys, "value"])
                if held is not None and held.num_rows == k:
                    least = held.column("value")[k - 1].as_py()
                    mine = mine.filter(pc.or_(pc.greater_equal(mine.column("value"), least), pc.is_nan(mine.column("value"))))
                every = mine if held is None else pa.concat_tables([held, mine])
                best[c] = every.take(pc.sort_indices(every, order, null_placement="at_start")[:k])
        for c, rows in best.items():
            rows = rows.add_column(len(keys), "feature", pa.array([c] * rows.num_rows))
            yield from rows.combine_chunks().to_batches()

    return x.mapInArrow(run, schema)


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int, salt_of: Column, salts: int = 64) -> DataFrame:
    """Exact top-k per group without sorting a whole (possibly huge) group in one task: rank inside
    (group, salt) first, keep k per salt, then rank the <= salts*k survivors per group."""
    s = df.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)))
    w1 = Window.partitionBy(group, "_salt").orderBy(*order)
    s = s.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1")
    w2 = Window.partitionBy(group).orderBy(*order)
    return s.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k).drop("_salt")


# ---- A39: quality of period keys ----

KEY_FORMAT = r"^\d{4}-\d{4}-[12]$"
COVERAGE_TARGET = 0.8


def key_conflicts(df: DataFrame, by: list[str], entity: str, event: str, key: str) -> DataFrame:
    """Per `by`: distinct (entity, event) pairs and those that carry more than one key. Two levels of aggregation: the least and
    greatest key of a pair tell whether they differ, so no pair keeps a set and a hot entity is combined map-side."""
    pair = df.groupBy(*by, entity, event).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    return pair.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("_lo") != F.col("_hi")).alias("conflicting_events"))


def period_key_quality(keys: DataFrame) -> DataFrame:
    """Per source the share of rows with a key (target 80 %), distinct keys, the share in the `YYYY-YYYY-{1,2}` format, and how
    many (entity, event) pairs have conflicting keys. keys: source, entity, event, pk."""
    cov = F.avg(F.col("pk").isNotNull().cast("double"))
    rates = keys.groupBy("source").agg(cov.alias("coverage"), F.countDistinct("pk").alias("n_keys"),
                                       F.avg(F.coalesce(F.col("pk").rlike(KEY_FORMAT), F.lit(False)).cast("double")).alias("format_ok_rate"),
                                       (cov >= COVERAGE_TARGET).alias("meets_target"))
    return rates.join(key_conflicts(keys, ["source"], "entity", "event", "pk"), "source")
