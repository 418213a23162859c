"""Registered queries: clustering quality on given labels (M1-M8), explanations (E1-E3, P24), scenario metrics
(A34-A35) with SQL oracles, and model fits (C1-C9, E5) checked by invariants (rows-only at the driver)."""

from __future__ import annotations

from pyspark.sql import functions as F

from termlens import config as C
from termlens.operators import cluster as CL
from termlens.operators import cluster_metrics as CM
from termlens.operators import mixture as MX
from termlens.operators import model_eval as EV
from termlens.operators import model_store as MS
from termlens.operators import prep as PP
from termlens.operators.marts import MART_COLUMNS
from termlens.operators.profiles import soft_labels
from termlens.plans import sql_exprs as X
from termlens.operators.quantiles import exact_quantiles
from termlens.plans.registry import query
from termlens.plans.sql_bindings import CTES
from termlens.sources.tables import Tables

K = C.N_MODES
P_COLS = X.P_COLS
Q_COLS = [f"q_mode_{i}" for i in range(K)]
KEYS = ["entity_id", "period_key"]
FEATS = MART_COLUMNS


def _emb(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return e.select("vec_id", "label", (F.col("vec_id") % 10).cast("int").alias("label2"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _scored(spark, sf_dir):
    return soft_labels(Tables(spark, sf_dir))


def _with_q(s):
    """Second fixed posterior over the same rows (w'_i = 1 + ((cnt*(i+2) + id*(i+1)) mod 7))."""
    cnt, eid = F.col("_cnt"), F.col("entity_id").cast("long")
    w = [(F.lit(1) + ((cnt * (i + 2) + eid * (i + 1)) % 7)).cast("double") for i in range(K)]
    tot = w[0]
    for v in w[1:]:
        tot = tot + v
    return s.select("*", *[(w[i] / tot).alias(Q_COLS[i]) for i in range(K)])


def _scored_pq(spark, sf_dir):
    from termlens.operators.marts import materialized_mart
    t = Tables(spark, sf_dir)
    mart = materialized_mart(t)
    from termlens.operators.profiles import scored_mart
    s = scored_mart(mart, carry=[F.col("grade_course_cnt").alias("_cnt")])
    return _with_q(s)


_QW = [f"CAST(1 + ((CAST(m.grade_course_cnt AS BIGINT) * {i + 2} + CAST(s.entity_id AS BIGINT) * {i + 1}) % 7) AS DOUBLE)"
       for i in range(K)]
CTES["scored_pq"] = f"""
  SELECT s.*, {', '.join(f'{_QW[i]} / ({" + ".join(_QW)}) AS q_mode_{i}' for i in range(K))}
  FROM scored s JOIN mart m USING (entity_id, period_key)"""

CTES["emb"] = """
  SELECT vec_id, label, CAST(vec_id % 10 AS INTEGER) AS label2, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"""
CTES["emb_cent"] = """
  SELECT label, list(v ORDER BY i) AS c, any_value(n) AS n FROM (
    SELECT label, i, avg(v) AS v, count(*) AS n FROM (
      SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM emb) GROUP BY label, i) GROUP BY label"""


# ---- M1-M8 ----

@query("silhouette", """
WITH s AS (SELECT vec_id, label, x FROM emb WHERE label IS NOT NULL ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 1024),
d AS (SELECT s.vec_id, s.label AS la, e.label AS lb, list_distance(s.x, e.x) AS d FROM s JOIN emb e ON s.vec_id <> e.vec_id WHERE e.label IS NOT NULL),
per AS (SELECT vec_id, la, lb, avg(d) AS md FROM d GROUP BY vec_id, la, lb),
ab AS (SELECT vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM per GROUP BY vec_id)
SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab""")
def q_silhouette(spark, sf_dir):
    """M1: exact Euclidean silhouette of a fixed sample of rows (order of md5) against all rows."""
    e = _emb(spark, sf_dir).where("label IS NOT NULL")
    sample = e.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(EV.SILHOUETTE_ROWS)
    return EV.silhouette(e, "x", "label", sample)


@query("silhouette_sq", """
WITH d AS (SELECT a.vec_id, a.label AS la, b.label AS lb,
                  list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d2
           FROM emb a JOIN emb b ON a.vec_id <> b.vec_id),
per AS (SELECT vec_id, la, lb, avg(d2) AS md FROM d GROUP BY vec_id, la, lb),
ab AS (SELECT vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM per GROUP BY vec_id)
SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette_sq FROM ab""")
def q_silhouette_sq(spark, sf_dir):
    return CM.silhouette_sq(_emb(spark, sf_dir), "x", "label")


@query("calinski_harabasz", """
WITH g AS (SELECT list(v ORDER BY i) AS c FROM (SELECT i, avg(v) AS v FROM (
             SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM emb) GROUP BY i)),
B AS (SELECT sum(n * list_sum(list_transform(list_zip(emb_cent.c, g.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS b,
             count(*) AS k FROM emb_cent, g),
W AS (SELECT sum(list_sum(list_transform(list_zip(e.x, c.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS w, count(*) AS n
      FROM emb e JOIN emb_cent c USING (label))
SELECT (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz FROM B, W""")
def q_calinski_harabasz(spark, sf_dir):
    return CM.calinski_harabasz(_emb(spark, sf_dir), "x", "label")


@query("davies_bouldin", """
WITH s AS (SELECT label, avg(sqrt(list_sum(list_transform(list_zip(e.x, c.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))) AS s
           FROM emb e JOIN emb_cent c USING (label) GROUP BY label),
pr AS (SELECT a.label AS i, max((sa.s + sb.s) / sqrt(list_sum(list_transform(list_zip(a.c, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))) AS r
       FROM emb_cent a JOIN emb_cent b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label
       GROUP BY a.label)
SELECT avg(r) AS davies_bouldin FROM pr""")
def q_davies_bouldin(spark, sf_dir):
    return CM.davies_bouldin(_emb(spark, sf_dir), "x", "label")


_CT = "(SELECT label AS a, label2 AS b, count(*) AS n FROM emb GROUP BY 1, 2)"


@query("adjusted_rand", f"""
WITH ct AS {_CT},
s AS (SELECT sum(n * (n - 1) / 2.0) AS sij, sum(n) AS n FROM ct),
sa AS (SELECT sum(m * (m - 1) / 2.0) AS sa FROM (SELECT sum(n) AS m FROM ct GROUP BY a)),
sb AS (SELECT sum(m * (m - 1) / 2.0) AS sb FROM (SELECT sum(n) AS m FROM ct GROUP BY b)),
e AS (SELECT sij, sa * sb / (n * (n - 1) / 2.0) AS ex, (sa + sb) / 2.0 AS mx FROM s, sa, sb)
SELECT CAST(CASE WHEN mx = ex THEN 1.0 ELSE (sij - ex) / (mx - ex) END AS DOUBLE) AS ari FROM e""")
def q_adjusted_rand(spark, sf_dir):
    return CM.adjusted_rand(_emb(spark, sf_dir), "label", "label2")


@query("normalized_mi", f"""
WITH ct AS {_CT}, tot AS (SELECT sum(n) AS ntot FROM ct),
ra AS (SELECT a, sum(n) AS na FROM ct GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM ct GROUP BY b),
mi AS (SELECT sum(n / ntot * ln(ntot * n / (na * nb))) AS mi FROM ct JOIN ra USING (a) JOIN rb USING (b), tot),
ha AS (SELECT -sum(na / ntot * ln(na / ntot)) AS ha FROM ra, tot), hb AS (SELECT -sum(nb / ntot * ln(nb / ntot)) AS hb FROM rb, tot)
SELECT CAST(CASE WHEN (ha + hb) / 2 <= 0 THEN 1.0 ELSE mi / ((ha + hb) / 2) END AS DOUBLE) AS nmi FROM mi, ha, hb""")
def q_normalized_mi(spark, sf_dir):
    return CM.normalized_mi(_emb(spark, sf_dir), "label", "label2")


@query("prob_l1", "SELECT avg(" + " + ".join(f"abs(p_mode_{i} - q_mode_{i})" for i in range(K)) + f") / {K} AS prob_mean_l1 FROM scored_pq")
def q_prob_l1(spark, sf_dir):
    return CM.prob_l1(_scored_pq(spark, sf_dir), P_COLS, Q_COLS)


def _jsd_sql():
    t = []
    for i in range(K):
        p = f"least(greatest(p_mode_{i}, 1e-12), 1.0)"
        q = f"least(greatest(q_mode_{i}, 1e-12), 1.0)"
        m = f"(({p} + {q}) * 0.5)"
        t.append(f"0.5 * ({p} * ln({p} / {m}) + {q} * ln({q} / {m}))")
    return " + ".join(t)


@query("prob_jsd", f"SELECT avg({_jsd_sql()}) AS prob_mean_jsd FROM scored_pq")
def q_prob_jsd(spark, sf_dir):
    return CM.prob_jsd(_scored_pq(spark, sf_dir), P_COLS, Q_COLS)


@query("pmax_quantiles", """
SELECT avg(mode_pmax) AS pmax_mean, quantile_cont(mode_pmax, 0.1) AS pmax_p10, quantile_cont(mode_pmax, 0.5) AS pmax_p50,
       quantile_cont(mode_pmax, 0.9) AS pmax_p90 FROM scored""")
def q_pmax_quantiles(spark, sf_dir):
    return CM.pmax_quantiles(_scored(spark, sf_dir))


# ---- E1-E3, P24 ----

def _hint_sql(f: str, z: str, hints: dict) -> str:
    hi = " ".join(f"WHEN '{k}' THEN '{h}'" for k, (h, _) in hints.items())
    lo = " ".join(f"WHEN '{k}' THEN '{l}'" for k, (_, l) in hints.items())
    return f"CASE WHEN {z} > 0 THEN (CASE lower({f}) {hi} END) ELSE (CASE lower({f}) {lo} END) END"


def _top_sql(label: str, parent: str | None) -> str:
    pk = parent if parent else "0"
    dbl = ", ".join(f"CAST(mart.{c} AS DOUBLE) AS {c}" for c in FEATS)
    pos = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(FEATS)) + " END"
    return f"""
WITH base AS (SELECT {pk} AS _p, scored.{label} AS cluster_id, {dbl} FROM scored JOIN mart USING (entity_id, period_key)),
long AS (SELECT * FROM base UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATS)}))),
cm AS (SELECT _p, cluster_id, feature, avg(value) AS mean_cluster FROM long GROUP BY ALL),
cs AS (SELECT _p, cluster_id, count(*) AS cluster_size FROM base GROUP BY ALL),
om AS (SELECT _p, feature, avg(value) AS mean_overall, stddev_pop(value) AS sd FROM long GROUP BY ALL),
tot AS (SELECT _p, count(*) AS tot FROM base GROUP BY _p),
z AS (SELECT cm._p, cm.cluster_id, cs.cluster_size, cs.cluster_size / tot.tot AS cluster_pct, cm.feature, {pos} AS pos,
             mean_cluster, mean_overall,
             CASE WHEN sd IS NULL OR isnan(sd) OR sd <= 1e-12 THEN 1.0 ELSE sd END AS std_overall
      FROM cm JOIN om USING (_p, feature) JOIN cs USING (_p, cluster_id) JOIN tot USING (_p)),
z2 AS (SELECT *, coalesce(CASE WHEN isnan((mean_cluster - mean_overall) / std_overall) THEN NULL
                               ELSE (mean_cluster - mean_overall) / std_overall END, 0.0) AS z FROM z)
SELECT {f'_p AS {parent}, ' if parent else ''}cluster_id, cluster_size, cluster_pct, feature, z, abs(z) AS abs_z,
       CASE WHEN z > 0 THEN '高' ELSE '低' END AS direction_vs_overall, mean_cluster, mean_overall, std_overall,
       {_hint_sql('feature', 'z', C.SUBTYPE_HINTS if parent else C.DIR_HINTS)} AS interpretation_hint, rank
FROM (SELECT *, row_number() OVER (PARTITION BY _p, cluster_id ORDER BY round_even(abs(z), 9) DESC, pos) AS rank FROM z2) WHERE rank <= 10"""


def _top(spark, sf_dir, label, parent=None):
    from termlens.operators.marts import materialized_mart
    t = Tables(spark, sf_dir)
    mart = materialized_mart(t)
    from termlens.operators.profiles import scored_mart
    df = scored_mart(mart, carry=FEATS)
    return CM.cluster_top_features(df, label, FEATS, parent=parent, hints=C.SUBTYPE_HINTS if parent else C.DIR_HINTS)


@query("cluster_top_features", _top_sql("mode_id", None))
def q_cluster_top_features(spark, sf_dir):
    return _top(spark, sf_dir, "mode_id")


@query("subtype_top_features", _top_sql("subtype_id", "mode_id"))
def q_subtype_top_features(spark, sf_dir):
    return _top(spark, sf_dir, "subtype_id", "mode_id")


@query("cluster_name_draft", f"""
SELECT cluster_id, cluster_size, cluster_pct,
       CASE WHEN len(h) = 0 THEN '{CM.MIXED_NAME}' ELSE array_to_string(list_slice(h, 1, 3), '、') END AS name_draft
FROM (SELECT cluster_id, cluster_size, cluster_pct,
             list_distinct_ordered(interpretation_hint) AS h FROM (
        SELECT * FROM ({_top_sql('mode_id', None)}) ORDER BY cluster_id, rank) GROUP BY ALL)""".replace(
    "list_distinct_ordered(interpretation_hint)",
    "list_filter(list_transform(list_sort(list_filter(list(struct_pack(r := rank, h := interpretation_hint)), "
    "lambda e: e.h IS NOT NULL)), lambda e: e.h), lambda x, i: i = 1 OR NOT list_contains(list_slice(list_transform("
    "list_sort(list_filter(list(struct_pack(r := rank, h := interpretation_hint)), lambda e: e.h IS NOT NULL)), "
    "lambda e: e.h), 1, i - 1), x))"))
def q_cluster_name_draft(spark, sf_dir):
    return CM.cluster_name_draft(_top(spark, sf_dir, "mode_id"))


@query("direction_label", f"""
SELECT DISTINCT feature, direction_vs_overall, interpretation_hint FROM ({_top_sql('mode_id', None)})""")
def q_direction_label(spark, sf_dir):
    return _top(spark, sf_dir, "mode_id").select("feature", "direction_vs_overall", "interpretation_hint").distinct()


# ---- A34 / A35: scenario metrics on two fixed posteriors ----

def _scenario_rows(s, pc, tag):
    p = F.array(*[F.col(c) for c in pc])
    from termlens.operators import scores as S
    lab = s.select(S.hard_label(p).alias("l"), S.entropy(p).alias("e"), S.pmax(p).alias("pm"),
                   (S.pmax(p) - S.psecond(p)).alias("mg"))
    share = lab.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    tot = lab.count()
    sh = share.agg(F.min("n").alias("mn"), F.max("n").alias("mx")).first()
    r = lab.agg(F.avg("e").alias("entropy_mean"), F.avg("pm").alias("pmax_mean"), F.avg("mg").alias("margin_mean")).first()
    return [(tag, "entropy_mean", r["entropy_mean"]), (tag, "pmax_mean", r["pmax_mean"]), (tag, "margin_mean", r["margin_mean"]),
            (tag, "min_mode_share", sh["mn"] / tot), (tag, "max_mode_share", sh["mx"] / tot)]


def _scen_sql(pc, tag):
    arr = "[" + ", ".join(pc) + "]"
    return f"""SELECT '{tag}' AS scenario, metric, value FROM (
  SELECT avg(e) AS entropy_mean, avg(pm) AS pmax_mean, avg(mg) AS margin_mean,
         (SELECT min(c) FROM (SELECT count(*) AS c FROM lab_{tag} GROUP BY l)) / count(*) AS min_mode_share,
         (SELECT max(c) FROM (SELECT count(*) AS c FROM lab_{tag} GROUP BY l)) / count(*) AS max_mode_share FROM lab_{tag})
  UNPIVOT (value FOR metric IN (entropy_mean, pmax_mean, margin_mean, min_mode_share, max_mode_share))"""


for _tag, _pc in (("baseline", P_COLS), ("alt", Q_COLS)):
    _arr = "[" + ", ".join(_pc) + "]"
    CTES[f"lab_{_tag}"] = f"""
  SELECT list_position({_arr}, list_max({_arr})) - 1 AS l,
         -list_sum(list_transform({_arr}, lambda x: least(greatest(x, 1e-12), 1.0) * ln(least(greatest(x, 1e-12), 1.0)))) AS e,
         list_max({_arr}) AS pm, list_max({_arr}) - list_sort({_arr}, 'DESC')[2] AS mg FROM scored_pq"""

_SCEN_SQL = _scen_sql(P_COLS, "baseline") + " UNION ALL " + _scen_sql(Q_COLS, "alt")
# Whether a larger value of a scenario metric is better.
HIGHER_BETTER = {"entropy_mean": False, "pmax_mean": True, "margin_mean": True, "min_mode_share": True,
                 "max_mode_share": False}


@query("scenario_metrics", _SCEN_SQL)
def q_scenario_metrics(spark, sf_dir):
    s = _scored_pq(spark, sf_dir).cache()
    rows = _scenario_rows(s, P_COLS, "baseline") + _scenario_rows(s, Q_COLS, "alt")
    s.unpersist()
    return spark.createDataFrame(rows, "scenario string, metric string, value double")


@query("scenario_compare", f"""
SELECT metric, baseline, alt, alt - baseline AS delta,
       CASE {' '.join(f"WHEN metric = '{k}' THEN {'true' if v else 'false'}" for k, v in HIGHER_BETTER.items())} END AS higher_is_better,
       CASE WHEN ({' OR '.join(f"metric = '{k}'" for k, v in HIGHER_BETTER.items() if v)}) THEN alt - baseline > 0
            ELSE alt - baseline < 0 END AS improved
FROM (SELECT metric, max(value) FILTER (WHERE scenario = 'baseline') AS baseline, max(value) FILTER (WHERE scenario = 'alt') AS alt
      FROM ({_SCEN_SQL}) GROUP BY metric)""")
def q_scenario_compare(spark, sf_dir):
    long = q_scenario_metrics(spark, sf_dir)
    wide = long.groupBy("metric").pivot("scenario", ["baseline", "alt"]).agg(F.first("value"))
    hb = F.create_map(*[e for k, v in HIGHER_BETTER.items() for e in (F.lit(k), F.lit(v))])
    d = F.col("alt") - F.col("baseline")
    return wide.select("metric", "baseline", "alt", d.alias("delta"), F.element_at(hb, F.col("metric")).alias("higher_is_better"),
                       F.when(F.element_at(hb, F.col("metric")), d > 0).otherwise(d < 0).alias("improved"))


# ---- fits (rows-only; invariants in tests) ----

def _dims(spark, sf_dir):
    return _scored(spark, sf_dir).select(*KEYS, *C.DIM_COLS)


def _screen_features(spark, sf_dir):
    """Screening input: features with <= 60 % missing, median-filled, z-scaled (run_eda screening step)."""
    from termlens.operators import quality as QL
    from termlens.operators.marts import materialized_mart
    mart = materialized_mart(Tables(spark, sf_dir))
    keep = [r["feature"] for r in QL.keep_low_missing(QL.missing_rates(mart, FEATS)).collect()]
    return PP.zscore_matrix(mart, KEYS, keep), keep


@query("kmeans_sweep")
def q_kmeans_sweep(spark, sf_dir):
    z, keep = _screen_features(spark, sf_dir)
    return CL.kmeans_sweep(z, keep)


@query("kmeans_stability")
def q_kmeans_stability(spark, sf_dir):
    z, keep = _screen_features(spark, sf_dir)
    return CL.kmeans_stability(z, keep)


@query("gmm_select_bic")
def q_gmm_select_bic(spark, sf_dir):
    return CL.gmm_select_bic(_dims(spark, sf_dir), C.DIM_COLS)[0]


def _fixed_model():
    """A model stated by rule, so that scoring has an exact twin: component i, dimension r, c."""
    import numpy as np
    d = len(C.DIM_COLS)
    mean = [[((i * (j + 2)) % 5 - 2) * 0.5 for j in range(d)] for i in range(K)]
    factor = [[[1 + 0.1 * ((i + c) % 3) if r == c else 0.05 * ((i + r + c) % 4 - 1.5) if r < c else 0.0 for c in range(d)] for r in range(d)]
              for i in range(K)]
    return MX.Mixture(np.array([(i + 1) / (K * (K + 1) / 2) for i in range(K)]), np.array(mean), np.array(factor))


def _stored_model(spark):
    """The fixed model by way of its stored table, as a fitted one would come."""
    import uuid
    from termlens.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/termlens-model-{uuid.uuid4().hex}"
    MS.save_mixture(spark, _fixed_model(), path)
    return MS.load_mixture(spark, path)


CTES["posterior"] = f"""
  SELECT entity_id, period_key, {', '.join(f'max(p) FILTER (WHERE i = {i}) AS p_cluster_{i}' for i in range(8))} FROM (
    SELECT entity_id, period_key, i, exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY entity_id, period_key) AS p FROM (
      SELECT *, max(z) OVER (PARTITION BY entity_id, period_key) AS mz FROM (
        SELECT entity_id, period_key, y.i, ln((y.i + 1) / 36.0) + any_value(ld.s) - 3 * ln(2 * pi()) - 0.5 * sum(v * v) AS z
        FROM (SELECT entity_id, period_key, i, c, sum((x - ((i * (r + 2)) % 5 - 2) * 0.5)
                     * CASE WHEN r = c THEN 1 + 0.1 * ((i + c) % 3) ELSE 0.05 * ((i + r + c) % 4 - 1.5) END) AS v
              FROM (SELECT entity_id, period_key, unnest([{', '.join(C.DIM_COLS)}]) AS x, unnest(range(6)) AS r FROM scored),
                   range(8) AS a(i), range(6) AS b(c) WHERE r <= c GROUP BY entity_id, period_key, i, c) AS y
        JOIN (SELECT i, sum(ln(1 + 0.1 * ((i + c) % 3))) AS s FROM range(8) AS a(i), range(6) AS b(c) GROUP BY i) AS ld ON ld.i = y.i
        GROUP BY entity_id, period_key, y.i))) GROUP BY entity_id, period_key"""
_P8 = [f"p_cluster_{i}" for i in range(8)]
_P8_SQL = "[" + ", ".join(_P8) + "]"


@query("gmm_score", "SELECT * FROM posterior")
def q_gmm_score(spark, sf_dir):
    """C4: posterior per component from a stored model; nothing is fitted."""
    return MS.posterior_columns(_dims(spark, sf_dir), C.DIM_COLS, _stored_model(spark), _P8, KEYS)


@query("soft_assignment_table", f"""
SELECT entity_id, period_key, CAST(list_position({_P8_SQL}, list_max({_P8_SQL})) - 1 AS INTEGER) AS cluster_map, {', '.join(_P8)},
       list_max({_P8_SQL}) AS p_max, list_sort({_P8_SQL}, 'DESC')[2] AS p_second,
       list_max({_P8_SQL}) - list_sort({_P8_SQL}, 'DESC')[2] AS margin,
       -list_sum(list_transform({_P8_SQL}, lambda x: least(greatest(x, 1e-12), 1.0) * ln(least(greatest(x, 1e-12), 1.0)))) AS entropy
FROM posterior""")
def q_soft_assignment_table(spark, sf_dir):
    return MS.soft_assignment(_dims(spark, sf_dir), C.DIM_COLS, _stored_model(spark), KEYS)


def _filled(mart):
    """Every raw feature that has any value, median-filled."""
    n = mart.agg(*[F.count(c).alias(c) for c in FEATS]).first()
    raw = [c for c in FEATS if n[c]]
    return PP.median_impute(mart, KEYS, raw, flags=False), raw


@query("two_layer_cluster")
def q_two_layer_cluster(spark, sf_dir):
    from termlens.operators.marts import materialized_mart
    from termlens.operators.scores import dimension_scores
    mart = materialized_mart(Tables(spark, sf_dir))
    filled, raw = _filled(mart)
    df = dimension_scores(mart).join(filled, KEYS)
    return CL.two_layer_cluster(df, KEYS, C.DIM_COLS, raw).data


@query("align_components", f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT label % 4 AS a, vec_id % 4 AS b, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e WHERE label IS NOT NULL),
ma AS (SELECT a, list(v ORDER BY i) AS m FROM (SELECT a, i, avg(v) AS v FROM u GROUP BY ALL) GROUP BY a),
mb AS (SELECT b, list(v ORDER BY i) AS m FROM (SELECT b, i, avg(v) AS v FROM u GROUP BY ALL) GROUP BY b),
d AS (SELECT a, b, list_distance(ma.m, mb.m) AS dist FROM ma, mb),
p AS (SELECT w.b AS b0, x.b AS b1, y.b AS b2, z.b AS b3, w.dist + x.dist + y.dist + z.dist AS cost FROM d AS w, d AS x, d AS y, d AS z
      WHERE w.a = 0 AND x.a = 1 AND y.a = 2 AND z.a = 3 AND len(list_distinct([w.b, x.b, y.b, z.b])) = 4 ORDER BY cost LIMIT 1)
SELECT CAST(d.a AS INTEGER) AS component_a, CAST(d.b AS INTEGER) AS component_b, d.dist AS mean_distance
FROM d, p WHERE d.b = [b0, b1, b2, b3][d.a + 1]""")
def q_align_components(spark, sf_dir):
    """C8 on two given component sets: the means of the embeddings by label % 4 and by vec_id % 4 (the SQL tries all orders)."""
    import math
    x = _emb(spark, sf_dir).where("label IS NOT NULL").select((F.col("label") % 4).cast("int").alias("a"), (F.col("vec_id") % 4).cast("int").alias("b"), "x")
    means = {side: [[v / n for v in s] for _, (n, s, _) in sorted(CM.cluster_sums(x, "x", side).items())] for side in ("a", "b")}
    perm = CL.align_components(means["a"], means["b"])
    return spark.createDataFrame([(i, j, math.dist(means["a"][i], means["b"][j])) for i, j in enumerate(perm)],
                                 "component_a int, component_b int, mean_distance double")


@query("k_stability_eval")
def q_k_stability_eval(spark, sf_dir):
    return CL.k_stability_eval(_dims(spark, sf_dir), C.DIM_COLS)[1]


@query("choose_k")
def q_choose_k(spark, sf_dir):
    return CL.choose_k(CL.k_stability_eval(_dims(spark, sf_dir), C.DIM_COLS)[1])


@query("impute_ab_test")
def q_impute_ab_test(spark, sf_dir):
    """E5: the two-layer fit and the seed stability at K = 8 on median-filled against tier-imputed features, ten metrics."""
    from termlens.operators.marts import materialized_mart
    from termlens.operators.scores import dimension_scores
    mart = materialized_mart(Tables(spark, sf_dir))
    filled, raw = _filled(mart)
    tiered = PP.tiered_impute(mart, "entity_id", "period_key", FEATS).data
    frames = {"baseline": dimension_scores(mart).join(filled, KEYS),
              "imputed": dimension_scores(tiered).join(PP.median_impute(tiered, KEYS, raw, flags=False), KEYS)}
    got = CL.paired_experiment(frames, KEYS, C.DIM_COLS, raw, K)
    return CL.compare_scenarios(got.metrics, "baseline", "imputed")


# ---- A23, W4, T5, P26 ----

def _stats_sql() -> str:
    dbl = ", ".join(f"CAST(mart.{c} AS DOUBLE) AS {c}" for c in FEATS)
    return f"""
WITH base AS (SELECT scored.mode_id AS cluster_id, {dbl} FROM scored JOIN mart USING (entity_id, period_key)),
long AS (SELECT * FROM base UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATS)})))
SELECT cluster_id, feature, avg(value) AS mean, median(value) AS median, count(value) AS count FROM long GROUP BY ALL"""


@query("cluster_profile_stats", _stats_sql())
def q_cluster_profile_stats(spark, sf_dir):
    """Per cluster x feature mean, non-null count (one grouped wide aggregate, k rows, then `stack`) and the exact
    median (distributed)."""
    from termlens.operators.marts import materialized_mart
    from termlens.operators.profiles import scored_mart
    mart = materialized_mart(Tables(spark, sf_dir))
    df = scored_mart(mart, carry=FEATS)
    aggs = []
    for c in FEATS:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.count(x).alias(f"{c}__count")]
    wide = df.groupBy(F.col("mode_id").alias("cluster_id")).agg(*aggs)
    args = ", ".join(f"'{c}', `{c}__mean`, `{c}__count`" for c in FEATS)
    long = wide.selectExpr("cluster_id", f"stack({len(FEATS)}, {args}) AS (feature, mean, count)")
    med = exact_quantiles(df.withColumnRenamed("mode_id", "cluster_id"), FEATS, [0.5], ["cluster_id"]).withColumnRenamed("q0", "median")
    return long.join(med, ["cluster_id", "feature"], "left").select("cluster_id", "feature", "mean", "median", "count")


@query("top_n_features", f"SELECT cluster_id, rank, feature, abs_z FROM ({_top_sql('mode_id', None)})")
def q_top_n_features(spark, sf_dir):
    """The top 10 features by |z| per cluster (row_number over <= p rows per cluster)."""
    return _top(spark, sf_dir, "mode_id").select("cluster_id", "rank", "feature", "abs_z")


@query("top_loadings")
def q_top_loadings(spark, sf_dir):
    """T5: 20 features by |loading| on PC1 and PC2 of the z-scaled screening features."""
    z, keep = _screen_features(spark, sf_dir)
    model, _ = PP.pca_fit(z, keep, 2)
    pc = model.pc.toArray()
    rows = [(j + 1, keep[i], float(pc[i, j])) for j in range(pc.shape[1]) for i in range(len(keep))]
    from pyspark.sql import Window
    d = spark.createDataFrame(rows, "component int, feature string, loading double")
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")   # p rows per component
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 20)


# The profile table's published column order (names that are absent are skipped).
PROFILE_ORDER = ["entity_id", "period_key", "XB", "XSM", "ZYM", "CLASS_NAME", "mode_id", "mode_name", "mode_pmax",
                 "mode_margin", "mode_entropy", *[f"p_mode_{i}" for i in range(K)], "subtype_id", "subtype_name",
                 "subtype_note", "subtype_pmax", "mode_evidence", *C.DIM_COLS, *C.KEY_METRICS]


@query("select_existing", "SELECT " + ", ".join(c for c in PROFILE_ORDER if c != "subtype_pmax") + " FROM profiles")
def q_select_existing(spark, sf_dir):
    """Ordered column list, absent columns (here `subtype_pmax`) skipped."""
    from termlens.operators.profiles import entity_profiles
    p = entity_profiles(Tables(spark, sf_dir))
    return p.select(*[c for c in PROFILE_ORDER if c in p.columns])
