"""Tables behind the reference's figures (V1-V11); drawing itself is out of scope.

Binning is arithmetic on columns (no collect of points); global ranges are one aggregate each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens import config as C
from termlens.functions.nulls import canonical
from termlens.session import stored

N_BINS = 30


def histogram(df: DataFrame, col: str, bins: int = N_BINS, lo: float | None = None, hi: float | None = None,
              series: str | None = None) -> DataFrame:
    """V1: equal-width bins over [lo, hi] (data range when not given); values outside are dropped, the last bin is
    closed as in NumPy. Returns (series, bin, lo_edge, hi_edge, n) for non-empty bins."""
    x = canonical(F.col(col).cast("double"))      # bin edges are compared at 1e-9 (engine-independent)
    if lo is None or hi is None:
        r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        lo, hi = r["lo"], r["hi"]
    width = (hi - lo) if hi != lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width) * bins), F.lit(bins - 1)).cast("int")
    d = df.where((x >= lo) & (x <= hi)).select(b.alias("bin"))
    g = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.lit(series or col).alias("series"), "bin",
                    (F.lit(lo) + F.col("bin") * F.lit(width / bins)).alias("lo_edge"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width / bins)).alias("hi_edge"), "n")


def stacked_group_modes(rollup: DataFrame, group_col: str, label_min: float = 0.08) -> DataFrame:
    """V2: group x mode share (null -> 0) from the n-weighted rollup, with the label threshold flag."""
    long = rollup.select(group_col, F.explode(F.array(*[F.struct(F.lit(i).alias("mode_id"),
                                                                 F.coalesce(F.col(f"mode_{i}_pct"), F.lit(0.0)).alias("share"))
                                                        for i in range(C.N_MODES)])).alias("m"))
    return long.select(group_col, "m.mode_id", "m.share", (F.col("m.share") >= label_min).alias("show_label"))


def group_dim_heatmap(rollup: DataFrame, group_col: str) -> DataFrame:
    """V3: group x dimension mean and the global max |value| (colour scale), over the aggregated rollup rows."""
    long = rollup.select(group_col, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{d}_mean").alias("value"))
                                                        for d in C.DIM_COLS])).alias("m")).select(group_col, "m.*")
    return long.withColumn("vmax", F.lit(long.agg(F.max(F.abs("value"))).first()[0]).cast("double"))     # one number


def group_risk_split(rollup: DataFrame, group_col: str) -> DataFrame:
    """V4: the two risk modes and their total per group, ascending by total."""
    a, b = C.RISK_MODES
    ra = F.coalesce(F.col(f"mode_{a}_pct"), F.lit(0.0))
    rb = F.coalesce(F.col(f"mode_{b}_pct"), F.lit(0.0))
    return rollup.select(group_col, ra.alias(f"mode_{a}_pct"), rb.alias(f"mode_{b}_pct"), (ra + rb).alias("risk_total")) \
        .orderBy("risk_total", group_col)


def mode_radar(mode_dims: DataFrame) -> DataFrame:
    """V7: modes x dimensions (long)."""
    return mode_dims.select("mode_id", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"))
                                                           for d in C.DIM_COLS])).alias("m")).select("mode_id", "m.*")


def density_grid(df: DataFrame, x: str, y: str, label: str, grid: int = 240, min_points: int = 30,
                 levels=(0.92, 0.82)) -> DataFrame:
    """V8 (re-aimed kernel density): per cluster with >= `min_points` points, counts on a grid x grid lattice over
    the global range, plus the cell-count quantile levels (core .92 / cover .82) of that cluster."""
    # bins compared at 1e-9; the points are written once: two aggregates read them, and the generated code of scores, labels
    # and an aggregate together is too long for the JVM's compiler
    df = stored(df.select(label, canonical(F.col(x)).alias(x), canonical(F.col(y)).alias(y)), "points")
    r = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    wx = (r["x1"] - r["x0"]) or 1.0
    wy = (r["y1"] - r["y0"]) or 1.0
    bx = F.least(F.floor((F.col(x) - r["x0"]) / wx * grid), F.lit(grid - 1)).cast("int")
    by = F.least(F.floor((F.col(y) - r["y0"]) / wy * grid), F.lit(grid - 1)).cast("int")
    cells = df.groupBy(label, bx.alias("bin_x"), by.alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))
    lv = cells.groupBy(label).agg(F.sum("n").alias("_n"), F.percentile("n", F.array(*[F.lit(q) for q in levels])).alias("_q")) \
        .where(F.col("_n") >= min_points)
    return cells.join(lv, label).select(label, "bin_x", "bin_y", "n", F.col("_q")[0].alias("level_core"),
                                        F.col("_q")[1].alias("level_cover"))


def row_as_pairs(row_df: DataFrame, exclude_prefixes=("p_mode_", "dim_")) -> DataFrame:
    """One row's numeric columns as (metric, value) pairs, probabilities and scores left out."""
    cols = [f.name for f in row_df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer")
            and not f.name.startswith(exclude_prefixes)]
    return row_df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("metric"),
                                                      F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)]))
                         .alias("m")).select("m.*")
