"""Entity profiles and group profiles.

Group tables are one `groupBy(group, period)` with conditional aggregates (one pass, partial aggregation
pre-combines hot groups map-side); no pivot job, no per-group Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens import config as C
from termlens.operators import scores as S
from termlens.operators.marts import build_feature_mart, materialized_mart
from termlens.functions.nulls import mean_of_rounded, np_round
from termlens.sources import bindings as B
from termlens.sources.tables import Tables

KEYS = ["entity_id", "period_key"]
P_COLS = [f"p_mode_{i}" for i in range(C.N_MODES)]
BLANK_GROUPS = ("", "nan", "None")


def mode_label_table(spark) -> DataFrame:
    """Id -> name / description as a dimension table (8 rows; broadcast is size-bounded)."""
    rows = [(i, C.MODE_NAMES[i], C.MODE_DESCRIPTIONS[i]) for i in range(C.N_MODES)]
    return spark.createDataFrame(rows, "mode_id int, mode_name string, mode_desc string")


def mode_name_expr(c) -> Column:
    """P21 as an inline map (8 literals) — avoids a join entirely."""
    m = F.create_map(*[x for i in range(C.N_MODES) for x in (F.lit(i), F.lit(C.MODE_NAMES[i]))])
    return F.element_at(m, (F.col(c) if isinstance(c, str) else c).cast("int"))


def subtype_name_expr(c, fallback: bool = False) -> Column:
    """Subtype name as an inline map; unknown ids are null, or the fallback word with the id."""
    x = F.col(c) if isinstance(c, str) else c
    name = F.element_at(F.create_map(*[v for k, n in C.SUBTYPE_NAMES.items() for v in (F.lit(k), F.lit(n))]), x.cast("int"))
    return F.coalesce(name, F.concat(F.lit(C.SUBTYPE_FALLBACK), x.cast("string"))) if fallback else name


def most_frequent_class(t: Tables) -> DataFrame:
    """Per entity the most frequent (class id, class name) over homework and sign-in rows; ties -> smallest
    key (Q10: null classes never vote). One aggregate: min(struct(-n, id, name))."""
    hw = B.homework(t).select(F.col("CREATER_LOGIN_NAME").alias("XH"), F.col("CLASS_ID").alias("cid"),
                              F.col("CLASS_NAME").alias("cname"))
    si = B.signin(t).select(F.col("LOGIN_NAME").alias("XH"), F.col("CLASSID").alias("cid"), F.col("CLASSNAME").alias("cname"))
    u = hw.unionByName(si).where(F.col("XH").isNotNull() & (F.col("cid").isNotNull() | F.col("cname").isNotNull()))
    counts = u.groupBy("XH", "cid", "cname").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("XH").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), "cid", "cname")).alias("b"))
    return best.select("XH", F.col("b.cid").alias("CLASS_ID"), F.col("b.cname").alias("CLASS_NAME"),
                       (-F.col("b.neg_n")).alias("class_votes"))


def scored_mart(mart: DataFrame, carry: list | None = None) -> DataFrame:
    """Mart + six dimension scores + fixed-rule soft labels in one projection (no self-join); `carry` adds more
    mart columns (names or Columns) to the same projection."""
    inputs = S.score_inputs()
    params = S.zscore_fit(mart, inputs)
    z = {c: S.zscore_expr(c, *params[c]) for c in inputs}
    dims = []
    for dim, comps in C.DIM_WEIGHTS.items():
        e = None
        for m, w in comps:
            e = F.lit(float(w)) * z[m] if e is None else e + F.lit(float(w)) * z[m]
        dims.append(e.alias(dim))
    more = [c for c in (carry or []) if not (isinstance(c, str) and c in C.KEY_METRICS)]
    return S.fixture_soft_labels(mart, extra=[*dims, *C.KEY_METRICS, *more])


LABEL_COLS = ["mode_id", *[f"p_mode_{i}" for i in range(C.N_MODES)], "mode_pmax", "mode_margin", "mode_entropy", "subtype_id", "subtype_note"]


def soft_labels(t: Tables, materialize: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """Labels, dimension scores and key metrics by (entity, period). `labels` are those of a fit (the output of
    `cluster.two_layer_cluster`, keys of any type); without them the fixed-rule ones are computed."""
    mart = materialized_mart(t) if materialize else build_feature_mart(t)
    if labels is None:
        return scored_mart(mart)
    missing = [c for c in [*KEYS, *LABEL_COLS] if c not in labels.columns]
    if missing:
        raise ValueError(f"label columns missing: {missing}")
    got = labels.select(*KEYS, *LABEL_COLS)
    return S.dimension_scores(mart).join(mart.select(*KEYS, *C.KEY_METRICS), KEYS).join(got, KEYS)


def entity_profiles(t: Tables, materialize: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """Labels + dims + key metrics + basic attributes + class, with mode and subtype names and evidence text;
    floats rounded to 4 places (P25). `labels`: see `soft_labels`."""
    sm = soft_labels(t, materialize, labels)
    basic = B.basic_info(t).select(F.col("XH").alias("entity_id"), "XB", "XSM", "ZYM")
    cls = most_frequent_class(t).select(F.col("XH").alias("entity_id"), "CLASS_NAME")
    df = sm.join(basic, "entity_id", "left").join(cls, "entity_id", "left")
    df = df.select(*KEYS, "XB", "XSM", "ZYM", "CLASS_NAME", "mode_id", mode_name_expr("mode_id").alias("mode_name"),
                   "mode_pmax", "mode_margin", "mode_entropy", *P_COLS, "subtype_id", subtype_name_expr("subtype_id").alias("subtype_name"),
                   "subtype_note", S.evidence_text().alias("mode_evidence"), *C.DIM_COLS, *C.KEY_METRICS)
    return round_floats(df, 4)


def round_floats(df: DataFrame, places: int = 4) -> DataFrame:
    """P25: every double / float column rounded to `places` as pandas does."""
    return df.select(*[np_round(F.col(f.name), places).alias(f.name) if f.dataType.typeName() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])


def drop_blank_groups(group_col: str) -> Column:
    """skip null, blank, `nan` and `None` group names."""
    g = F.trim(F.col(group_col).cast("string"))
    return F.col(group_col).isNotNull() & ~g.isin(*BLANK_GROUPS)


def by_level(df: DataFrame, levels: dict[str, str], aggs: list[Column], period: str = "period_key") -> DataFrame:
    """(level, group_name, period, aggregates): all group levels from one scan, one grouping set a level. Null group names
    and null periods are groups of their own."""
    cols = list(levels.values())
    g = df.groupingSets([[c, period] for c in cols], *cols, period).agg(*[F.grouping(c).alias(f"_out{i}") for i, c in enumerate(cols)], *aggs)
    level, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (lv, c) in enumerate(levels.items()):
        level = F.when(F.col(f"_out{i}") == 0, F.lit(lv)).otherwise(level)
        name = F.when(F.col(f"_out{i}") == 0, F.col(c).cast("string")).otherwise(name)
    return g.withColumns({"level": level, "group_name": name}).drop(*cols, *[f"_out{i}" for i in range(len(cols))])


def _mode_aggs() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_records"), *[F.sum((F.col("mode_id") == i).cast("long")).alias(f"c{i}") for i in range(C.N_MODES)],
            *[mean_of_rounded(d).alias(f"{d}_mean") for d in C.DIM_COLS], *[mean_of_rounded(m).alias(f"{m}_avg") for m in C.KEY_METRICS]]


def _mode_columns(g: DataFrame, keys: list[str]) -> DataFrame:
    cnt = F.array(*[F.col(f"c{i}") for i in range(C.N_MODES)])
    dom = (F.array_position(cnt, F.array_max(cnt)) - 1).cast("int")
    return g.select(
        *keys, "n_records",
        *[np_round(F.col(f"c{i}") / F.col("n_records"), 4).alias(f"mode_{i}_pct") for i in range(C.N_MODES)],
        dom.alias("dominant_mode_id"), mode_name_expr(dom).alias("dominant_mode_name"),
        *[f"{d}_mean" for d in C.DIM_COLS], *[f"{m}_avg" for m in C.KEY_METRICS])


def group_profile_modes(profiles: DataFrame, group_col: str) -> DataFrame:
    """A19 + A20: per (group, period) n, 8 mode shares, dominant mode (smallest id on ties), 6 dimension means,
    15 metric means of the (4-place) profile values, rounded to 4 places exactly (mean_of_rounded). Null periods stay a group (dropna=False)."""
    g = profiles.where(drop_blank_groups(group_col)).groupBy(group_col, "period_key").agg(*_mode_aggs())
    return _mode_columns(g, [group_col, "period_key"])


def level_profile_modes(profiles: DataFrame, levels: dict[str, str] = C.GROUP_LEVELS) -> DataFrame:
    """A19 + A20 + P34: the same for all levels in one scan, as (level, group_name, period_key, ...)."""
    g = by_level(profiles, levels, _mode_aggs()).where(drop_blank_groups("group_name"))
    return _mode_columns(g, ["level", "group_name", "period_key"])


#: fixed values: group levels of the cluster profiles
CLUSTER_LEVELS = {"sex": "XB", "ethnicity": "MZMC", "politics": "ZZMMMC", "college": "XSM", "major": "ZYM", "class": "CLASS_NAME"}


def level_profile_clusters(labels: DataFrame, attrs: DataFrame, levels: dict[str, str] = CLUSTER_LEVELS, label_col: str = "mode_id",
                           k: int = C.N_MODES, metrics: list[str] = C.KEY_METRICS) -> DataFrame:
    """A18 at all levels in one scan: (level, group_name, period_key, n, cluster shares, metric means); the share of a cluster
    that a group does not have is null (Q8)."""
    counts = [F.sum((F.col(label_col) == i).cast("long")).alias(f"c{i}") for i in range(k)]
    g = by_level(labels.join(attrs, "entity_id", "left"), levels, [F.count(F.lit(1)).alias("n"), *counts, *[F.avg(m).alias(f"{m}_mean") for m in metrics]])
    return g.select("level", "group_name", "period_key", "n",
                    *[F.when(F.col(f"c{i}") > 0, F.col(f"c{i}") / F.col("n")).alias(f"cluster_{i}_pct") for i in range(k)], *[f"{m}_mean" for m in metrics])


def group_profile_clusters(labels: DataFrame, attrs: DataFrame, group_col: str, label_col: str = "mode_id",
                           k: int = C.N_MODES, metrics: list[str] | None = None, fill_absent=None) -> DataFrame:
    """Per (group, period) cluster shares and metric means; shares of clusters absent from a group are
    null (`fill_absent=None`, Q8) or 0."""
    metrics = metrics or []
    df = labels.join(attrs, "entity_id", "left")
    counts = [F.sum((F.col(label_col) == i).cast("long")).alias(f"c{i}") for i in range(k)]
    g = df.groupBy(group_col, "period_key").agg(F.count(F.lit(1)).alias("n"), *counts,
                                                *[F.avg(m).alias(f"{m}_mean") for m in metrics])
    shares = []
    for i in range(k):
        s = F.col(f"c{i}") / F.col("n")
        shares.append((F.when(F.col(f"c{i}") > 0, s) if fill_absent is None else F.coalesce(
            F.when(F.col(f"c{i}") > 0, s), F.lit(float(fill_absent)))).alias(f"cluster_{i}_pct"))
    return g.select(group_col, "period_key", "n", *shares, *[f"{m}_mean" for m in metrics])


def mode_distribution(labels: DataFrame, label_col: str = "mode_id") -> DataFrame:
    """Count and share per mode (global total via a window over the <= k aggregated rows)."""
    from pyspark.sql import Window
    c = labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return c.select(label_col, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))


def mode_profile_dims(labels: DataFrame) -> DataFrame:
    """Per mode size, share and six dimension means."""
    from pyspark.sql import Window
    g = labels.groupBy("mode_id").agg(F.count(F.lit(1)).alias("size"), *[F.avg(d).alias(d) for d in C.DIM_COLS])
    return g.select("mode_id", "size", (F.col("size") / F.sum("size").over(Window.partitionBy())).alias("pct"),
                    *C.DIM_COLS)


def mode_definitions(labels: DataFrame) -> DataFrame:
    """Per mode (all k, absent -> size 0): name, description, size, pct, dimension means as a map."""
    spark = labels.sparkSession
    dims = mode_profile_dims(labels)
    base = spark.range(C.N_MODES).select(F.col("id").cast("int").alias("mode_id"))
    j = base.join(F.broadcast(mode_label_table(spark)), "mode_id", "left").join(dims, "mode_id", "left")
    dim_map = F.map_from_arrays(F.array(*[F.lit(d) for d in C.DIM_COLS]),
                                F.array(*[np_round(F.coalesce(F.col(d), F.lit(0.0)), 4) for d in C.DIM_COLS]))
    return j.select("mode_id", F.col("mode_name").alias("name"), F.col("mode_desc").alias("description"),
                    F.coalesce(F.col("size"), F.lit(0)).alias("size"),
                    np_round(F.coalesce(F.col("pct"), F.lit(0.0)), 4).alias("pct"), dim_map.alias("dim_profile"))


def subtype_definitions(labels: DataFrame) -> DataFrame:
    """A22 + J5: per subtype size and share within its mode (window over the aggregated rows only)."""
    from pyspark.sql import Window
    g = labels.where(F.col("subtype_id").isNotNull()).groupBy("mode_id", "subtype_id").agg(F.count(F.lit(1)).alias("size"))
    return g.select("mode_id", "subtype_id", mode_name_expr("mode_id").alias("mode_name"),
                    subtype_name_expr("subtype_id", fallback=True).alias("name"), "size",
                    np_round(F.col("size") / F.sum("size").over(Window.partitionBy("mode_id")), 4).alias("pct_in_mode"))


def weighted_rollup(groups: DataFrame, group_col: str, value_cols: list[str], weight_col: str = "n_records") -> DataFrame:
    """N-weighted mean over periods, nulls ignored column by column; null weight -> 1."""
    w = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0))
    return groups.groupBy(group_col).agg(*[
        (F.sum(F.col(v) * w) / F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in value_cols])


def unweighted_rollup(groups: DataFrame, group_col: str, value_cols: list[str]) -> DataFrame:
    """Mean of non-null values over periods; n_records summed (0 -> null)."""
    return groups.groupBy(group_col).agg(
        F.nullif(F.sum("n_records"), F.lit(0)).alias("n_records"), *[F.avg(v).alias(v) for v in value_cols])


def group_numeric_cols() -> list[str]:
    return ([f"mode_{i}_pct" for i in range(C.N_MODES)] + [f"{d}_mean" for d in C.DIM_COLS]
            + [f"{m}_avg" for m in C.KEY_METRICS])


def risk_share(prefix: str = "mode_", suffix: str = "_pct") -> Column:
    """Share of the at-risk modes, missing -> 0."""
    e = None
    for m in C.RISK_MODES:
        t = F.coalesce(F.col(f"{prefix}{m}{suffix}"), F.lit(0.0))
        e = t if e is None else e + t
    return e


def risk_level(c) -> Column:
    """> .30 high, > .15 watch, else good."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x > C.RISK_HIGH, F.lit(C.RISK_LABELS[0])).when(x > C.RISK_WATCH, F.lit(C.RISK_LABELS[1])) \
        .otherwise(F.lit(C.RISK_LABELS[2]))
