"""Serving layer: filters, lookups, rollups, rankings and small per-row rules over the profile and group tables
(F2-F5, F9-F11, A26-A28, A37-A38, W5-W8, T1-T8, P27-P32, P34).

Everything is a DataFrame expression: ranking is `orderBy + limit` (TakeOrderedAndProject keeps only k rows per
partition), per-entity ranks are windows partitioned by entity, never a global window over unaggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens import config as C
from termlens.operators import profiles as PR


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Q12 guard: a right-hand attribute table must have one row per key, or a left join multiplies rows.
    The check is one aggregate (count(*) vs count(distinct key)); raises on violation."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d")).first()
    if r["n"] != r["d"]:
        raise ValueError(f"{key} is not unique: {r['n']} rows, {r['d']} keys")
    return df


def confidence_band(pmax) -> Column:
    """p_max bands 0.80 / 0.60 / 0.40."""
    p = _c(pmax)
    hi, mid, lo = C.CONF_BANDS
    return (F.when(p >= hi, F.lit(C.CONF_LABELS[0])).when(p >= mid, F.lit(C.CONF_LABELS[1]))
            .when(p >= lo, F.lit(C.CONF_LABELS[2])).otherwise(F.lit(C.CONF_LABELS[3])))


def ranked_modes(p_cols: list[str]) -> Column:
    """Modes sorted by probability desc, id asc: array<struct<np: -p, i: id>>."""
    return F.array_sort(F.array(*[F.struct((-F.col(c)).alias("np"), F.lit(i).alias("i")) for i, c in enumerate(p_cols)]))


def top3_modes_row(scored: DataFrame, p_cols: list[str]) -> DataFrame:
    """The three most likely modes of each row (long form)."""
    r = scored.select("entity_id", "period_key", F.posexplode(F.slice(ranked_modes(p_cols), 1, 3)).alias("pos", "t"))
    return r.select("entity_id", "period_key", F.col("t.i").alias("mode_id"), (-F.col("t.np")).alias("p"),
                    (F.col("pos") + 1).alias("rank"))


def entity_overall(scored: DataFrame, cols: list[str]) -> DataFrame:
    """Mean of probabilities and dimensions across an entity's periods."""
    return scored.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_periods"), *[F.avg(c).alias(c) for c in cols])


def top3_modes_entity(scored: DataFrame, p_cols: list[str]) -> DataFrame:
    """Three modes by mean probability over the entity's periods."""
    o = entity_overall(scored, p_cols)
    r = o.select("entity_id", F.posexplode(F.slice(ranked_modes(p_cols), 1, 3)).alias("pos", "t"))
    return r.select("entity_id", F.col("t.i").alias("mode_id"), (-F.col("t.np")).alias("p"), (F.col("pos") + 1).alias("rank"))


def latest_period(df: DataFrame) -> DataFrame:
    """Last row by period per entity (max_by over a struct: one aggregate, no sort)."""
    cols = [c for c in df.columns if c != "entity_id"]
    agg = df.groupBy("entity_id").agg(F.max_by(F.struct(*cols), F.col("period_key")).alias("r"))
    return agg.select("entity_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def period_series(groups: DataFrame, group_col: str, group: str, metric: str) -> DataFrame:
    """One group's rows in period order, long form: mode shares x100, chosen metric, six dimensions."""
    g = groups.where(F.col(group_col) == group)
    cols = [(F.col(f"mode_{i}_pct") * 100).alias(f"mode_{i}_pct") for i in range(C.N_MODES)] + [F.col(metric)] + \
        [F.col(f"{d}_mean") for d in C.DIM_COLS]
    w = g.select("period_key", *cols)
    names = [c for c in w.columns if c != "period_key"]
    return w.unpivot("period_key", names, "metric", "value")


def entity_lookup(profiles: DataFrame, entity: str, period: str | None = None) -> DataFrame:
    """exact id (trimmed), optional exact period, ordered by period."""
    p = profiles.where(F.col("entity_id") == entity.strip())
    if period:
        p = p.where(F.col("period_key") == period)
    return p.orderBy("period_key")


def group_filter(groups: DataFrame, group_col: str, group: str, period: str | None = None) -> DataFrame:
    """group = g and (period empty or = t)."""
    g = groups.where(F.col(group_col) == group)
    return g.where(F.col("period_key") == period) if period else g


def name_search(df: DataFrame, name_col: str, needle: str) -> DataFrame:
    """case-blind literal substring on the group name."""
    return df.where(F.lower(F.col(name_col)).contains(needle.lower()))


def row_search(df: DataFrame, cols: list[str] | None, needle: str, period: str | None, order: list[str], limit: int | None = None) -> DataFrame:
    """case-blind substring over the row as JSON (all columns unless `cols` says otherwise), optional period filter,
    total order; `limit` rows if given."""
    d = df.where(F.lower(F.to_json(F.struct(*(cols or df.columns)), {"ignoreNullFields": "false"})).contains(needle.lower()))
    if period:
        d = d.where(F.col("period_key") == period)
    d = d.orderBy(*order)
    return d if limit is None else d.limit(limit)


def distinct_picklist(groups: DataFrame, group_col: str) -> DataFrame:
    """distinct non-empty groups and periods (long form: kind, value)."""
    g = groups.select(F.lit("group").alias("kind"), F.col(group_col).cast("string").alias("value"))
    p = groups.select(F.lit("period").alias("kind"), F.col("period_key").alias("value"))
    u = g.distinct().unionByName(p.distinct())
    return u.where(F.col("value").isNotNull() & (F.col("value") != ""))


def class_rows_nonempty(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """keep rows with a class id or a class name."""
    return df.where(F.col(id_col).isNotNull() | F.col(name_col).isNotNull())


def long_group_table(profiles: DataFrame) -> DataFrame:
    """P34 + A19: all levels in one long table (level, group_name, ...), from one scan."""
    return PR.level_profile_modes(profiles)


def level_rows(long_groups: DataFrame, level: str) -> DataFrame:
    return long_groups.where(F.col("level") == level)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def risk_leaderboard(groups: DataFrame, group_col: str, order: str = "risk_desc", limit: int = 100) -> DataFrame:
    """Rollup groups over periods (A26), risk share (P29) and level (P30), four orders, first `limit`;
    the group name is the tie-break so the cut is deterministic."""
    r = PR.unweighted_rollup(groups, group_col, PR.group_numeric_cols())
    risk = PR.risk_share()
    r = r.select(F.col(group_col).alias("group_name"), "n_records", risk.alias("risk"), PR.risk_level(risk).alias("risk_level"),
                 "kccj_mean_avg", "kccj_fail_rate_avg")
    orders = {
        "risk_desc": [F.desc("risk")],
        "risk_asc": [F.asc("risk")],
        "score_asc": [F.asc(F.coalesce(F.when(F.col("kccj_mean_avg") != 0, F.col("kccj_mean_avg")), F.lit(99.0)))],
        "fail_desc": [F.desc(F.coalesce(F.col("kccj_fail_rate_avg"), F.lit(0.0)))],
    }
    return r.orderBy(*orders[order], F.asc("group_name")).limit(limit)


def risk_bucket_counts(groups: DataFrame, group_col: str) -> DataFrame:
    """Number of groups > .30, (.15, .30], <= .15."""
    r = PR.unweighted_rollup(groups, group_col, PR.group_numeric_cols()).select(PR.risk_share().alias("r"))
    return r.agg(F.count_if(F.col("r") > C.RISK_HIGH).alias("n_high"),
                  F.count_if((F.col("r") > C.RISK_WATCH) & (F.col("r") <= C.RISK_HIGH)).alias("n_watch"),
                  F.count_if(F.col("r") <= C.RISK_WATCH).alias("n_good"))


def overall_shares(dist: DataFrame) -> DataFrame:
    """Summed share of modes {1, 6} and {2, 3}."""
    return dist.agg(F.sum(F.when(F.col("mode_id").isin(*C.RISK_MODES), F.col("pct")).otherwise(0.0)).alias("risk_pct"),
                    F.sum(F.when(F.col("mode_id").isin(2, 3), F.col("pct")).otherwise(0.0)).alias("strong_pct"))


def est_mode_size(share, n) -> Column:
    """round(share x n), half-up as in JS Math.round."""
    return F.floor(_c(share) * _c(n) + 0.5).cast("long")


def short_period(c) -> Column:
    """`2020-2021-1` -> `0-1-1`."""
    return F.regexp_replace(_c(c), r"^\d{3}(\d)-\d{3}(\d)-(\d)$", "$1-$2-$3")


def safe_rel_change(a, b, eps: float = 1e-12) -> Column:
    """(b - a) / |a|, dividing by 1 when |a| <= eps."""
    return (_c(b) - _c(a)) / F.when(F.abs(_c(a)) > eps, F.abs(_c(a))).otherwise(F.lit(1.0))
