"""Shared-pass model fits against plain numpy restatements."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.operators import cluster as CL
from termlens.operators import mixture as MX
from termlens.operators import model_eval as EV
from termlens.operators import model_store as MS


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = np.random.default_rng(11)
    x = np.vstack([rnd.normal(m, 0.4, (n, 2)) for m, n in ((0.0, 150), (3.0, 120), (7.0, 180))])
    truth = np.repeat([0, 1, 2], [150, 120, 180])
    df = spark.createDataFrame([(str(i), float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, truth))],
                               "k string, a double, b double, truth int").repartition(5)
    return x, truth, df


def plain_log_likelihood(x, m):
    out = []
    for w, mu, f in zip(m.weights, m.means, m.factors):
        cov = np.linalg.inv(f @ f.T)
        d = x - mu
        out.append(math.log(w) - 0.5 * (len(mu) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
    z = np.array(out).T
    top = z.max(axis=1)
    return float((top + np.log(np.exp(z - top[:, None]).sum(axis=1))).sum()), np.exp(z - top[:, None]) / np.exp(z - top[:, None]).sum(axis=1, keepdims=True)


def test_mixtures_rise_and_report_the_likelihood_of_their_parameters(blobs):
    x, _, df = blobs
    fits = MX.mixture_fits(MX.matrix(df, ["a", "b"]), MX.grid((2, 3, 4), (1, 2), 2))
    assert len(fits) == 12
    for m in fits:
        assert all(b >= a - 1e-7 * abs(a) for a, b in itertools.pairwise(m.history))
        assert m.log_likelihood == pytest.approx(plain_log_likelihood(x, m)[0], rel=1e-9) and m.rows == 450
        p = m.k * 2 + m.k * 3 + m.k - 1
        assert m.bic == pytest.approx(-2 * m.log_likelihood + p * math.log(450)) and m.aic == pytest.approx(2 * p - 2 * m.log_likelihood)
    again = MX.mixture_fits(MX.matrix(df, ["a", "b"]), MX.grid((3,), (1,), 1))[0]
    assert again.log_likelihood == pytest.approx(fits[4].log_likelihood, rel=1e-6)          # a grid does not change its members


def test_one_em_step_is_the_plain_one(blobs):
    x, _, df = blobs
    table = MX.matrix(df, ["a", "b"])
    m = MX.mixture_fits(table, MX.grid((3,), (5,), 1), max_rounds=1)[0]
    got = MX._step(MX.summed(table, MX._em_stats, [(0, 0, m)])[0], 3, 2, 1e-6)
    _, r = plain_log_likelihood(x, m)
    n = r.sum(axis=0)
    mu = r.T @ x / n[:, None]
    assert np.allclose(got[0], n / 450) and np.allclose(got[1], mu)
    for i in range(3):
        cov = (r[:, i, None] * (x - mu[i])).T @ (x - mu[i]) / n[i] + 1e-6 * np.eye(2)
        assert np.allclose(np.linalg.inv(got[2][i] @ got[2][i].T), cov)


def test_gmm_recovers_separated_mixture(blobs):
    _, truth, df = blobs
    t, best = CL.gmm_select_bic(df, ["a", "b"], range(1, 6))
    assert best.k == 3 and t.count() == 5
    sa = MS.soft_assignment(df, ["a", "b"], best, ["k"])
    got = {r["k"]: r["cluster_map"] for r in sa.collect()}
    table = np.zeros((3, 3))
    for i, c in enumerate(truth):
        table[c, got[str(i)]] += 1
    assert EV.adjusted_rand(table) > 0.99


def test_stored_model_scores_like_the_fit(blobs, spark, tmp_path):
    x, _, df = blobs
    table = MX.matrix(df, ["a", "b"], ["k"])
    m = MX.mixture_fits(table, MX.grid((4,), (3,), 1))[0]
    MS.save_mixture(spark, m, str(tmp_path / "model"))
    back = MS.load_mixture(spark, str(tmp_path / "model"))
    got = {r["k"]: list(r)[1:] for r in MS.posterior_columns(df, ["a", "b"], back, [f"p{i}" for i in range(4)], ["k"]).collect()}
    arrow = {r["k"]: r["_p"] for r in MX.posteriors(table, {0: m}, ["k"]).collect()}
    _, r = plain_log_likelihood(x, m)
    for i in range(450):
        assert np.allclose(got[str(i)], r[i], atol=1e-9) and np.allclose(arrow[str(i)], r[i], atol=1e-9)
    holes = spark.createDataFrame([("x", None, 1.0)], "k string, a double, b double")
    assert list(MS.posterior_columns(holes, ["a", "b"], back, [f"p{i}" for i in range(4)], ["k"]).first())[1:] == [None] * 4


def test_kmeans_is_at_a_fixed_point_and_starts_help(blobs):
    x, _, df = blobs
    fits = MX.kmeans_fits(MX.matrix(df, ["a", "b"]), MX.grid((3, 5), (1,), 6), tol=0.0)
    for f in fits:
        d = ((x[:, None] - f.centers[None]) ** 2).sum(axis=2)
        lab = d.argmin(axis=1)
        assert f.inertia == pytest.approx(d.min(axis=1).sum())
        for c in range(f.spec.k):
            if (lab == c).any():
                assert np.allclose(f.centers[c], x[lab == c].mean(axis=0))
    best = MX.best_of(fits)
    assert set(best) == {(0, 3, 1), (0, 5, 1)} and best[0, 3, 1].inertia == min(f.inertia for f in fits if f.spec.k == 3)


def test_groups_fit_apart_in_shared_passes(blobs, spark):
    x, truth, df = blobs
    table = MX.matrix(df, ["a", "b"], group="truth")
    fits = MX.mixture_fits(table, MX.grid((1, 2), (1,), 1, (0, 1, 2)))
    for m in fits:
        mine = x[truth == m.spec.group]
        assert m.rows == len(mine) and m.log_likelihood == pytest.approx(plain_log_likelihood(mine, m)[0], rel=1e-9)
        if m.k == 1:
            assert np.allclose(m.means[0], mine.mean(axis=0)) and np.allclose(np.linalg.inv(m.factors[0] @ m.factors[0].T), np.cov(mine.T, bias=True) + 1e-6 * np.eye(2))


def test_missing_features_are_refused(spark):
    df = spark.createDataFrame([("x", None, 1.0), ("y", 2.0, 1.0)], "k string, a double, b double")
    with pytest.raises(Exception, match="missing values"):
        MX.kmeans_fits(MX.matrix(df, ["a", "b"]), MX.grid((1,), (1,), 1))


def test_evaluation_against_plain_formulas(blobs):
    x, _, df = blobs
    table = MX.matrix(df, ["a", "b"])
    fits = MX.mixture_fits(table, MX.grid((3, 4), (1, 2), 1))
    perm = [2, 0, 1]
    models = [m for m in fits if m.k == 3] + [m for m in fits if m.k == 4]
    judged, agree = EV.evaluate(table, models, [(0, 1, perm), (0, 2, None)])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    labels, probs = [], []
    for m, e in zip(models, judged):
        _, r = plain_log_likelihood(x, m)
        lab = r.argmax(axis=1)
        labels.append(lab)
        probs.append(r)
        on = [c for c in range(m.k) if (lab == c).any()]
        s = []
        for i in range(450):
            own = (lab == lab[i]).sum()
            a = far[i, lab == lab[i]].sum() / max(own - 1, 1)
            b = min(far[i, lab == c].mean() for c in on if c != lab[i])
            s.append((b - a) / max(a, b) if own > 1 else 0.0)
        assert e["silhouette"] == pytest.approx(np.mean(s))                               # fewer rows than the sample: all of them
        cent = {c: x[lab == c].mean(axis=0) for c in on}
        w = sum(((x[lab == c] - cent[c]) ** 2).sum() for c in on)
        between = sum((lab == c).sum() * ((cent[c] - x.mean(axis=0)) ** 2).sum() for c in on)
        assert e["calinski_harabasz"] == pytest.approx(between / (len(on) - 1) / (w / (450 - len(on))))
        spread = {c: np.sqrt(((x[lab == c] - cent[c]) ** 2).sum(axis=1)).mean() for c in on}
        assert e["davies_bouldin"] == pytest.approx(np.mean([max((spread[c] + spread[o]) / math.dist(cent[c], cent[o]) for o in on if o != c) for c in on]))
        assert e["pmax_mean"] == pytest.approx(r.max(axis=1).mean()) and e["entropy_mean"] == pytest.approx(-(np.clip(r, 1e-12, 1) * np.log(np.clip(r, 1e-12, 1))).sum(axis=1).mean())
    p, q = probs[0], probs[1][:, perm]
    assert agree[0]["l1"] == pytest.approx(np.abs(p - q).mean())
    pc, qc = np.clip(p, 1e-12, 1), np.clip(q, 1e-12, 1)
    m = (pc + qc) / 2
    assert agree[0]["jsd"] == pytest.approx((0.5 * (pc * np.log(pc / m) + qc * np.log(qc / m)).sum(axis=1)).mean())
    pairs = list(itertools.combinations(range(450), 2))
    for e, other in ((agree[0], labels[1]), (agree[1], labels[2])):
        same = np.array([(labels[0][i] == labels[0][j], other[i] == other[j]) for i, j in pairs])
        both, one, two, n = (same[:, 0] & same[:, 1]).sum(), same[:, 0].sum(), same[:, 1].sum(), len(pairs)
        assert e["ari"] == pytest.approx((both - one * two / n) / ((one + two) / 2 - one * two / n))
    assert EV.normalized_mi(np.diag([5.0, 3.0])) == pytest.approx(1.0) and EV.normalized_mi(np.array([[4.0]])) == 1.0
    quantiles = EV.pmax_quantiles(table, {"m0": models[0]}, [0.1, 0.5, 0.9])["m0"]
    assert np.allclose(quantiles, np.quantile(probs[0].max(axis=1), [0.1, 0.5, 0.9]))


def test_two_layers(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(900):
        mode, sub = i % 3, (i // 3) % 2
        rows.append((f"pj{i}", *(rnd.normal(6.0 * mode, 0.3, 2)).tolist(), *(rnd.normal(4.0 * sub * (mode + 1), 0.4, 3)).tolist(), 1.0))
    rows += [(f"few{i}", *(rnd.normal(40.0, 0.3, 2)).tolist(), 0.0, 0.0, 0.0, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, d1 double, d2 double, r1 double, r2 double, r3 double, flat double")
    got = CL.two_layer_cluster(df, ["id"], ["d1", "d2"], ["r1", "r2", "r3", "flat"], k1=4, k2s=(2, 3), starts2=3)
    out = got.data.toPandas()
    assert len(out) == 950 and out.id.is_unique
    p = [c for c in out.columns if c.startswith("p_mode_")]
    assert np.allclose(out[p].sum(axis=1), 1) and (out[p].to_numpy().argmax(axis=1) == out.mode_id).all()
    assert np.allclose(out.mode_pmax, out[p].max(axis=1))
    few = out[out.id.str.startswith("few")]
    assert few.mode_id.nunique() == 1 and (few.subtype_id == 100 * few.mode_id).all()
    for m, g in out.groupby("mode_id"):
        mine = [c for c in out.columns if c.startswith(f"p_subtype_m{m}_")]
        other = [c for c in out.columns if c.startswith("p_subtype_") and c not in mine]
        assert g[other].isna().all().all()
        if m != few.mode_id.iloc[0]:
            assert np.allclose(g[mine].sum(axis=1), 1) and (g.subtype_id - 100 * m == g[mine].to_numpy().argmax(axis=1)).all()
            truth = (g.id.str[2:].astype(int) // 3) % 2
            cells = np.array([[((truth == a) & (g.subtype_id == b)).sum() for b in sorted(g.subtype_id.unique())] for a in (0, 1)], dtype=float)
            assert EV.adjusted_rand(cells) > 0.9
    notes = {(r["mode_id"], r["note"]) for r in got.subtypes.collect()}
    assert (int(few.mode_id.iloc[0]), "too_small_skip") in notes and got.modes.count() == 1


def test_stability_choice_and_experiment(blobs, spark):
    _, _, df = blobs
    pairs, summary = CL.k_stability_eval(df, ["a", "b"], (2, 3), (11, 22, 33), 2)
    assert pairs.count() == 6 and summary.columns == ["k", *CL.SUMMARY]
    rows = {r["k"]: r for r in summary.collect()}
    assert rows[3]["ari_pair_mean"] > 0.99 and rows[3]["silhouette_mean"] > rows[2]["silhouette_mean"]
    assert rows[3]["prob_l1_pair_mean"] < 0.01 and 0 <= rows[3]["entropy_norm_mean"] <= 1
    fixed = spark.createDataFrame([(k, *map(float, v)) for k, v in ((4, (0.9, 0.5, 0.1, 0.1)), (5, (0.9, 0.6, 0.2, 0.1)), (6, (0.99, 0.9, 0.5, 0.4)), (7, (0.9, 0.6, 0.1, 0.1)))],
                                  "k int, ari_pair_mean double, nmi_pair_mean double, prob_l1_pair_mean double, prob_jsd_pair_mean double")
    assert [r["k"] for r in CL.choose_k(fixed).collect()] == [6, 7, 5, 4]
    assert [(r["k"], r["stable"]) for r in CL.choose_k(fixed, min_ari=0.8, max_l1=0.3).collect()] == [(7, True), (5, True), (4, True), (6, False)]
    got = CL.paired_experiment({"baseline": df, "noisy": df.withColumn("a", F.col("a") + F.rand(3) * 2)}, ["k"], ["a", "b"], ["truth"], 3, (1, 2), 1,
                               k2s=(2,), starts1=1, starts2=1, min_rows=10_000)
    wide = {r["metric"]: r for r in CL.compare_scenarios(got.metrics, "baseline", "noisy").collect()}
    assert len(wide) == 10 and wide["mode_pmax_mean"]["direction"] == "higher_better" and wide["k3_bic_mean"]["direction"] == "lower_better"
    assert all(r["is_improved"] == int(r["delta"] > 0 if r["direction"] == "higher_better" else r["delta"] < 0) for r in wide.values())
