"""Sums of many models at once against one model at a time, without Spark."""

import numpy as np

from termlens.operators import mixture as MX


def _models(rnd, d, ks, groups):
    out = []
    for unit, k in enumerate(ks):
        f = np.triu(rnd.normal(size=(k, d, d)) * 0.2) + np.eye(d)
        w = rnd.random(k) + 0.1
        out.append((unit, unit % groups, MX.Mixture(w / w.sum(), rnd.normal(size=(k, d)), f)))
    return out


def _blocks(x, g, size):
    for at in range(0, len(x), size):
        yield None, g[at:at + size], x[at:at + size]


def test_mixture_sums_of_a_whole_grid_take_no_pass_a_model(monkeypatch):
    rnd = np.random.default_rng(1)
    d, n = 3, 3000
    x, g = rnd.normal(size=(n, d)), rnd.integers(0, 3, n)
    models = _models(rnd, d, [2, 4, 2, 3, 4, 1], 2)
    iu = np.triu_indices(d)
    want = {}
    for unit, group, m in models:
        rows = x[g == group]
        r, ll = MX.posterior(rows, m)
        want[unit] = np.concatenate([[ll.sum(), len(rows)], r.sum(axis=0), (r.T @ rows).ravel(), (r.T @ (rows[:, iu[0]] * rows[:, iu[1]])).ravel()])
    monkeypatch.setattr(MX, "posterior", None)
    got = MX._em_stats(_blocks(x, g, 170), models)
    assert sorted(got) == sorted(want)
    for unit in want:
        np.testing.assert_allclose(got[unit], want[unit], rtol=1e-9, atol=1e-9)


def test_lloyd_sums_of_a_whole_grid_take_the_first_of_equal_centres(monkeypatch):
    rnd = np.random.default_rng(2)
    x = rnd.integers(-3, 4, size=(2500, 2)).astype(float)
    g = rnd.integers(0, 2, len(x))
    models = [(i, i % 2, np.repeat(rnd.integers(-3, 4, size=(k, 2)).astype(float), 2, axis=0)) for i, k in enumerate([1, 3, 2, 3])]
    want = {}
    for unit, group, c in models:
        rows = x[g == group]
        far = ((rows[:, None] - c[None]) ** 2).sum(axis=2)
        hot = np.eye(len(c))[far.argmin(axis=1)]
        want[unit] = np.concatenate([[far.min(axis=1).sum()], hot.sum(axis=0), (hot.T @ rows).ravel()])
    monkeypatch.setattr(MX, "_nearest", None)
    got = MX._lloyd_stats(_blocks(x, g, 130), models)
    assert sorted(got) == sorted(want)
    for unit in want:
        np.testing.assert_allclose(got[unit], want[unit], rtol=1e-9, atol=1e-9)


def _peak(fn) -> int:
    import tracemalloc
    tracemalloc.start()
    fn()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_sums_of_many_models_are_taken_tile_by_tile():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(MX.ROWS_AT_ONCE, 4))
    g = np.zeros(len(x), dtype=np.int64)
    centers = [(i, 0, rnd.normal(size=(8, 4))) for i in range(600)]
    assert _peak(lambda: MX._lloyd_stats(_blocks(x, g, len(x)), centers)) < 12e6
    assert _peak(lambda: MX._em_stats(_blocks(x, g, len(x)), _models(rnd, 4, [8] * 400, 1))) < 12e6


def test_factors_in_pieces_give_the_log_densities():
    rnd = np.random.default_rng(4)
    for d in (MX.FORM_FEATURES + 1, MX.FACTOR_COLUMNS, 39):
        x, models = rnd.normal(size=(700, d)), [m for _, _, m in _models(rnd, d, [3] * 7, 1)]
        got = MX._log_joints(MX._quadratic(x, MX._Room()), *MX._factor_pieces(models), MX._Room())
        np.testing.assert_allclose(got, np.vstack([MX.log_joint(x, m).T for m in models]), rtol=1e-9, atol=1e-9)


def test_gaps_beyond_single_precision_are_compared_in_double():
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(size=(2000, 3)), rnd.normal(size=(50, 3)) * 1e-20, rnd.normal(size=(50, 3)) * 1e17])
    a = rnd.normal(size=(2, 3))
    models = [(0, 0, np.vstack([a, a + 1e-9, a - 1e-9])), (1, 0, np.vstack([a[0], a[0], a[1]])), (2, 0, np.vstack([a * 1e17, a, a * 1e-20]))]
    got = MX._lloyd_stats(_blocks(x, np.zeros(len(x), dtype=np.int64), 2050), models)
    for unit, _, c in models:
        far = -2 * x @ c.T + (c * c).sum(axis=1)
        near = np.where(far - far.min(axis=1)[:, None] <= 1e-13 * np.abs(far).max(axis=1)[:, None], np.arange(len(c)), len(c)).min(axis=1)
        label = far.argmin(axis=1)
        clear = np.bincount(label[label == near], minlength=len(c))
        n = got[unit][1:1 + len(c)]
        assert n.sum() == len(x) and (n >= clear).all() and np.abs(n - clear).sum() <= (label != near).sum() + 2


def test_scenarios_share_their_passes_and_keep_their_results(spark, monkeypatch):
    from termlens.operators import cluster as CL
    from termlens.operators import model_eval as EV
    rnd = np.random.default_rng(6)
    rows = [(f"k{i}", *rnd.normal(5.0 * (i % 2), 1.0, 2).tolist(), *rnd.normal(9.0 * (i // 2 % 2), 0.5, 2).tolist()) for i in range(240)]
    one = spark.createDataFrame(rows, "id string, a double, b double, r double, s double")
    two = one.selectExpr("id", "a * 2 + b AS a", "b", "r + s AS r", "s")
    fit = {"k2s": (2,), "starts1": 2, "starts2": 2, "min_rows": 50}
    calls = []
    fits = MX.mixture_fits
    monkeypatch.setattr(MX, "mixture_fits", lambda table, specs, *a, **k: calls.append(len(specs)) or fits(table, specs, *a, **k))
    got = CL.paired_experiment({"x": one, "y": two}, ["id"], ["a", "b"], ["r", "s"], 2, (1, 2), 1, **fit)
    assert len(calls) == 2                              # scores, then layer 2; before: three calls a scenario
    for tag, df in (("x", one), ("y", two)):
        alone = CL.two_layer_cluster(df, ["id"], ["a", "b"], ["r", "s"], 2, **fit)
        want, mine = ({r["id"]: r.asDict() for r in t.data.collect()} for t in (alone, got.tables[tag]))
        assert want.keys() == mine.keys()
        for k, r in want.items():
            assert r["mode_id"] == mine[k]["mode_id"]
            np.testing.assert_allclose([r["mode_pmax"], r["mode_entropy"]], [mine[k]["mode_pmax"], mine[k]["mode_entropy"]], rtol=1e-6, atol=1e-9)
        ids = [sorted({t[k]["subtype_id"] for k in t}) for t in (want, mine)]
        cells = np.array([[sum(want[k]["subtype_id"] == i and mine[k]["subtype_id"] == j for k in want) for j in ids[1]] for i in ids[0]], dtype=float)
        assert EV.adjusted_rand(cells) == 1 and len(ids[0]) == 4
        soft = CL.k_stability_eval(df, ["a", "b"], (2,), (1, 2), 1)[1].first()
        found = {r["metric"]: r["value"] for r in got.metrics.where(f"scenario = '{tag}'").collect()}
        for c in ("ari_pair_mean", "nmi_pair_mean", "bic_mean"):
            np.testing.assert_allclose(found[f"k2_{c}"], soft[c], rtol=1e-6)
