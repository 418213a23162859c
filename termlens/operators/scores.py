"""Z-scores, dimension scores, soft-label columns and rule text.

Statistics follow fit / transform: `fit` runs one aggregate over all columns at once and returns a small
dict of parameters (collected: O(columns)); `transform` inlines them as literals, so the scoring plan is a
single narrow projection with no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens import config as C
from termlens.functions.nulls import np_round

KEYS = ["entity_id", "period_key"]


# ---- P15 / X14: z-scores ----

def zscore_fit(df: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population sd of every column in ONE aggregate pass."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m__{c}"), F.stddev_pop(x).alias(f"s__{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m__{c}"], row[f"s__{c}"]) for c in cols}


def zscore_expr(c: str, mu: float | None, sd: float | None, eps: float = C.Z_EPS) -> Column:
    """Mean-fill then (x - mu) / sd with population sd; sd < eps -> 1; all-missing column -> null."""
    if mu is None:
        return F.lit(None).cast("double")
    s = 1.0 if (sd is None or sd != sd or sd < eps) else float(sd)
    return (F.coalesce(F.col(c).cast("double"), F.lit(float(mu))) - F.lit(float(mu))) / F.lit(s)


def zscore(df: DataFrame, cols: list[str], keep: list[str] | None = None, suffix: str = "") -> DataFrame:
    params = zscore_fit(df, cols)
    keep = keep if keep is not None else [c for c in df.columns if c not in cols]
    return df.select(*keep, *[zscore_expr(c, *params[c]).alias(c + suffix) for c in cols])


# ---- P16: dimension scores ----

def score_inputs() -> list[str]:
    return list(dict.fromkeys(m for comps in C.DIM_WEIGHTS.values() for m, _ in comps))


def dimension_scores(mart: DataFrame, weights: dict = C.DIM_WEIGHTS, keys: list[str] = KEYS) -> DataFrame:
    """Six signed weighted sums of z-scores; every input column must exist (Q15)."""
    inputs = list(dict.fromkeys(m for comps in weights.values() for m, _ in comps))
    missing = [c for c in inputs if c not in mart.columns]
    if missing:
        raise ValueError(f"dimension score inputs missing: {missing}")
    params = zscore_fit(mart, inputs)
    z = {c: zscore_expr(c, *params[c]) for c in inputs}
    out = []
    for dim, comps in weights.items():
        e = None
        for m, w in comps:
            term = F.lit(float(w)) * z[m]
            e = term if e is None else e + term
        out.append(e.alias(dim))
    return mart.select(*keys, *out)


# ---- P17-P19: soft-label columns from a probability array ----

def p_array(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def pmax(p: Column) -> Column:
    return F.array_max(p)


def psecond(p: Column) -> Column:
    """Second largest; 0 when there is only one component."""
    return F.when(F.size(p) >= 2, F.element_at(F.sort_array(p, asc=False), 2)).otherwise(F.lit(0.0))


def entropy(p: Column, eps: float = 1e-12) -> Column:
    """-sum p ln p with p clipped to [eps, 1] (natural log)."""
    return -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.least(F.greatest(x, F.lit(eps)), F.lit(1.0))
                        * F.log(F.least(F.greatest(x, F.lit(eps)), F.lit(1.0))))


def normalized_entropy(p: Column) -> Column:
    """Entropy / ln k (k = number of components)."""
    return entropy(p) / F.log(F.size(p).cast("double"))


def hard_label(p: Column) -> Column:
    """Argmax, first index on ties (0-based)."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def uncertainty_cols(p: Column, prefix: str = "mode_") -> list[Column]:
    mx, sc = pmax(p), psecond(p)
    return [mx.alias(f"{prefix}pmax"), (mx - sc).alias(f"{prefix}margin"), entropy(p).alias(f"{prefix}entropy")]


# ---- P20: subtype codec ----

def subtype_id(mode_id, local) -> Column:
    m, j = (F.col(mode_id) if isinstance(mode_id, str) else mode_id), (F.col(local) if isinstance(local, str) else local)
    return F.when(j.isNull() | (j == -1), F.lit(None).cast("int")).otherwise((m * 100 + j).cast("int"))


def subtype_note(sid) -> Column:
    s = F.col(sid) if isinstance(sid, str) else sid
    return F.when(s.isNotNull(), F.concat(F.lit("mode"), (s / 100).cast("int").cast("string"), F.lit("_sub"),
                                          (s % 100).cast("string")))


def subtype_parts(sid) -> tuple[Column, Column]:
    s = F.col(sid) if isinstance(sid, str) else sid
    return (F.floor(s / 100).cast("int"), (s % 100).cast("int"))


# ---- fixed-rule soft labels (FIXTURES: deterministic posterior from the mart, for SQL-checkable layers) ----

def fixture_weights(cnt: Column, eid: Column, k: int = C.N_MODES) -> list[Column]:
    return [(F.lit(1) + ((cnt * (i + 1) + eid * (i + 3)) % 11)).cast("double") for i in range(k)]


def fixture_soft_labels(mart: DataFrame, k: int = C.N_MODES, extra: list | None = None) -> DataFrame:
    """p_i = w_i / sum w, w_i = 1 + ((cnt*(i+1) + id*(i+3)) mod 11); hard label, uncertainty, subtype.
    `extra` columns (names or Columns over the mart) are carried through the same projection."""
    extra = extra or []
    cnt = F.col("grade_course_cnt").cast("long")
    eid = F.col("entity_id").cast("long")
    w = fixture_weights(cnt, eid, k)
    tot = w[0]
    for x in w[1:]:
        tot = tot + x
    probs = [(w[i] / tot).alias(f"p_mode_{i}") for i in range(k)]
    base = mart.select(*KEYS, F.col("grade_course_cnt").alias("_gcc"), *probs, *extra)
    pc = [f"p_mode_{i}" for i in range(k)]
    carried = [c for c in base.columns if c not in KEYS + pc + ["_gcc"]]
    p = p_array(pc)
    lab = base.select(*KEYS, *pc, hard_label(p).alias("mode_id"), *uncertainty_cols(p),
                      (F.col("_gcc") % 4).cast("int").alias("_local"), *carried)
    return lab.select(*KEYS, F.lit(k).alias("mode_k"), "mode_id", *pc,
                      "mode_pmax", "mode_margin", "mode_entropy",
                      subtype_id("mode_id", "_local").alias("subtype_id"),
                      subtype_note(subtype_id("mode_id", "_local")).alias("subtype_note"), *carried)


# ---- P22: score level words ----

def score_level(s) -> Column:
    x = F.col(s) if isinstance(s, str) else s
    a = F.abs(x)
    word = F.when(x > 0, F.lit("高")).otherwise(F.lit("低"))
    return (F.when(a >= C.LEVEL_STRONG, F.concat(F.lit("显著偏"), word))
            .when(a >= C.LEVEL_CLEAR, F.concat(F.lit("明显偏"), word))
            .when(a >= C.LEVEL_SLIGHT, F.concat(F.lit("偏"), word))
            .otherwise(F.lit(C.LEVEL_NEAR)))


# ---- P23: evidence text, built from arrays of structs (no UDF) ----

def _fmt(v: Column, kind: str, suffix: str) -> Column:
    if kind == "pct1":
        return F.format_string("%.1f%%", np_round(v * 100, 1))
    if kind == "f1":
        return F.concat(F.format_string("%.1f", np_round(v, 1)), F.lit(suffix))
    return F.concat(F.format_string("%.0f", np_round(v, 0)), F.lit(suffix))


def _detail(dim: str) -> Column:
    items = [F.when(F.col(m).isNotNull(), F.concat(F.lit(label), _fmt(F.col(m).cast("double"), kind, suf)))
             for m, label, kind, suf in C.DIM_EVIDENCE.get(dim, [])]
    if not items:
        return F.lit("")
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    return F.array_join(F.slice(arr, 1, 2), "，")


def evidence_text(dims: list[str] = C.DIM_COLS) -> Column:
    """Top <= 3 dimensions by |score| (skip < 0.10); all < 0.15 -> balanced sentence; none -> no-data sentence."""
    entries = []
    for i, d in enumerate(dims):
        s = F.col(d).cast("double")
        level = score_level(s)
        detail = _detail(d)
        part = F.when(detail != "", F.concat(F.lit(C.DIM_NAMES_CN[d]), level, F.lit("（"), detail, F.lit("）"))) \
            .otherwise(F.concat(F.lit(C.DIM_NAMES_CN[d]), level))
        entries.append(F.when(s.isNotNull(), F.struct((-F.abs(s)).alias("neg_abs"), F.lit(i).alias("idx"),
                                                      part.alias("part"))))
    arr = F.array_sort(F.filter(F.array(*entries), lambda x: x.isNotNull()))
    kept = F.slice(F.filter(arr, lambda x: -x["neg_abs"] >= C.EVIDENCE_SKIP), 1, 3)
    numbered = F.transform(kept, lambda x, i: F.concat(
        F.element_at(F.array(*[F.lit(n) for n in C.EVIDENCE_NUMBERS]), i + 1), x["part"]))
    return (F.when(F.size(arr) == 0, F.lit(C.EVIDENCE_NO_DATA))
            .when(-arr[0]["neg_abs"] < C.EVIDENCE_BALANCED_MAX, F.lit(C.EVIDENCE_BALANCED))
            .when(F.size(kept) == 0, F.lit(C.EVIDENCE_BALANCED))
            .otherwise(F.concat(F.array_join(numbered, "；"), F.lit("。"))))
