"""Many K-means and Gaussian-mixture models fitted in shared passes.

A pass is one scan of a stored feature matrix. Every task keeps, for every model that is still running, the sums that
its next step needs (K-means: rows, sums, squared distance; mixture: log-likelihood and n, sum r, sum r x, sum r x x^T by
component) and returns one small row a model; Spark adds them up by model and the driver turns them into the next parameters, whose
size depends on the grid only. Models belong to a group of rows (0 where there is one), so the second-layer mixtures
of all modes, component numbers and starts run in the same passes. Models that have settled drop out.

The likelihood a fit reports is the one its returned parameters have: a model stops before the step that would
change it by less than the tolerance. Starting centres are drawn by k-means++ from at most `SEED_ROWS` rows a group (those of least
hash, a documented bound); everything else reads all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from termlens.session import stored

SEED_ROWS = 4096             # rows of a group that starting centres are drawn from
ROWS_AT_ONCE = 1024
TILE = 1 << 16               # centres or components x rows worked on at once: they stay in a core's cache
FACTOR_COLUMNS = 13          # columns of triangular factors taken at once
FORM_FEATURES = 12           # up to so many features log densities are formed from quadratic terms (rounding grows with features)
INIT_ROUNDS = 10             # K-means rounds before a mixture's first step
REG_COVAR = 1e-6
LLOYD_TOL = 1e-4             # of the mean variance, as squared shift of the centres
EM_TOL = 1e-3                # of the mean log-likelihood
LOG_2PI = math.log(2 * math.pi)


@dataclass(frozen=True)
class Spec:
    """One model of a grid."""
    k: int
    seed: int
    start: int = 0
    group: int = 0
    draw: int | None = None      # number that the centres are drawn with, where it is not the group's


@dataclass
class KMeansFit:
    spec: Spec
    centers: np.ndarray
    inertia: float = math.inf
    rounds: int = 0


@dataclass
class Mixture:
    """weights (k), means (k, d), upper factors (k, d, d) with inverse covariance = factor @ factor^T."""
    weights: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    spec: Spec | None = None
    rows: int = 0
    log_likelihood: float = -math.inf
    rounds: int = 0
    history: list[float] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def log_dets(self) -> np.ndarray:
        return np.log(np.diagonal(self.factors, axis1=1, axis2=2)).sum(axis=1)

    @property
    def n_params(self) -> int:
        k, d = self.means.shape
        return k * d + k * d * (d + 1) // 2 + k - 1

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.n_params * math.log(max(1, self.rows))

    @property
    def aic(self) -> float:
        return 2 * self.n_params - 2 * self.log_likelihood


# ---------------------------------------------------------------- matrix

def matrix(df: DataFrame, cols: list[str], keys: list[str] = (), group: str | None = None, name: str = "matrix") -> DataFrame:
    """Stored table: keys, _g (group), _x (features as one array). Rows with a missing feature are an error: fill first."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])
    rows = df.select(*keys, (F.col(group).cast("int") if group else F.lit(0)).alias("_g"), x.alias("_x"))
    # dealt evenly once, since every pass reads it with all cores
    return stored(rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), name)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice, groups, features) of at most ROWS_AT_ONCE rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            x = part.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            if not np.isfinite(x).all():
                raise ValueError("features with missing values cannot be fitted or scored")
            yield part, part.column("_g").to_numpy(), x


def _add_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One running sum a unit."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for m, s in zip(b.column("unit").to_pylist(), b.column("stats")):
            v = np.frombuffer(s.as_py(), dtype=np.float64)
            total[m] = total[m] + v if m in total else v
    if total:
        yield _stats_batch(total)


def _stats_batch(stats: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(stats), pa.int32()), pa.array([v.astype(np.float64).tobytes() for v in stats.values()], pa.binary())],
                                      names=["unit", "stats"])


def summed(table: DataFrame, fn: Callable, payload) -> dict[int, np.ndarray]:
    """Sums over all rows: fn(blocks, payload) gives every task's dict unit -> vector. The payload is of the grid's size."""
    spark = table.sparkSession
    held = spark.sparkContext.broadcast(payload)

    def run(batches):
        got = fn(_blocks(batches), held.value)
        if got:
            yield _stats_batch(got)

    # no number of partitions: the sums are small, and a Python worker for every empty partition costs more than the pass
    try:
        rows = table.select("_g", "_x").mapInArrow(run, "unit int, stats binary").repartition("unit").mapInArrow(
            _add_batches, "unit int, stats binary").collect()                       # one row a unit
    finally:
        held.destroy()
    return {r["unit"]: np.frombuffer(r["stats"], dtype=np.float64) for r in rows}


def seed_rows(table: DataFrame, groups: list[int], limit: int = SEED_ROWS) -> dict[int, np.ndarray]:
    """At most `limit` rows of every group, those of least hash."""
    def least(g: int) -> np.ndarray:
        rows = table.where(F.col("_g") == g).select("_x", F.xxhash64("_x").alias("_h")).orderBy("_h", "_x").limit(limit).collect()
        return np.array([r["_x"] for r in rows], dtype=np.float64)

    with ThreadPoolExecutor(4) as pool:                 # a job a group
        return dict(zip(groups, pool.map(least, groups)))


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres drawn from the rows of x."""
    centers = [x[rng.integers(len(x))]]
    near = ((x - centers[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = near.sum()
        pick = int(np.searchsorted(np.cumsum(near), rng.random() * total)) if total > 0 else int(rng.integers(len(x)))
        centers.append(x[min(pick, len(x) - 1)])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(axis=1))
    return np.array(centers)


# ---------------------------------------------------------------- K-means

def _by_group(models: list[tuple[int, int, np.ndarray]]) -> dict[int, list[tuple[int, np.ndarray]]]:
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for unit, g, params in models:
        out.setdefault(g, []).append((unit, params))
    return out


def _nearest(x: np.ndarray, centers: np.ndarray, cuts: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Label and squared distance for each of several models whose centres are stacked."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(axis=1)
    labels, dists = [], []
    for a, b in zip(cuts, cuts[1:]):
        lab = d[:, a:b].argmin(axis=1)
        labels.append(lab)
        dists.append(np.maximum(d[np.arange(len(x)), a + lab], 0.0))
    return labels, dists


def _by_k(sizes: list[int]) -> list[tuple[int, list[int]]]:
    """(k, models of that size)."""
    out: dict[int, list[int]] = {}
    for i, k in enumerate(sizes):
        out.setdefault(k, []).append(i)
    return sorted(out.items())


def _group_rows(blocks, by: dict[int, list]) -> Iterator[tuple[int, np.ndarray]]:
    """(group, at most ROWS_AT_ONCE rows of it): the rows of a group are gathered over several blocks, so that products stay large."""
    held: dict[int, list[np.ndarray]] = {}
    for _, g, x in blocks:
        for group in np.unique(g).tolist():
            if group not in by:
                continue
            mine = held.setdefault(group, [])
            mine.append(x[g == group])
            if sum(map(len, mine)) >= ROWS_AT_ONCE:
                rows = np.vstack(mine)
                whole = len(rows) // ROWS_AT_ONCE * ROWS_AT_ONCE
                held[group] = [rows[whole:]]
                for at in range(0, whole, ROWS_AT_ONCE):
                    yield group, rows[at:at + ROWS_AT_ONCE]
    for group, mine in held.items():
        rows = np.vstack(mine)
        if len(rows):
            yield group, rows


def _tiles(sizes: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(k, models of that size), so many that their centres x rows are about a tile."""
    for k, at in _by_k(sizes):
        step = max(1, TILE // (ROWS_AT_ONCE * abs(k)))
        for a in range(0, len(at), step):
            yield k, at[a:a + step]


class _Room:
    """Arrays used again for every tile: fresh ones of this size would be mapped anew each time."""

    def __init__(self):
        self.held: dict[tuple[str, type], np.ndarray] = {}

    def get(self, name: str, shape: tuple[int, ...], kind: type = np.float64) -> np.ndarray:
        size = math.prod(shape)
        flat = self.held.get((name, kind))
        if flat is None or len(flat) < size:
            flat = self.held[name, kind] = np.empty(size, kind)
        return flat[:size].reshape(shape)


def _nearest_hot(k: int, w: np.ndarray, w32: np.ndarray, one: np.ndarray, one32: np.ndarray, slack: np.ndarray | None, room: _Room) -> np.ndarray:
    """models x k x rows: true at the nearest centre, the first of equally near ones. Single precision decides where the gap to the
    second is beyond what rounding can change (`slack`, a bound); the others, and all without a bound, are compared in double."""
    m, n = len(w) // k, len(one)
    hot = room.get("hot", (m, k, n), np.bool_)
    if slack is None:
        hot[...] = True
    else:
        d = np.matmul(w32, one32, out=room.get("d", (m * k, n), np.float32)).reshape(m, k, n)
        least = np.min(d, axis=1, out=room.get("least", (m, n), np.float32))
        least += slack
        np.less_equal(d, least[:, None, :], out=hot)
    if np.count_nonzero(hot) != hot.size // k:
        model, row = np.nonzero(np.add.reduce(hot.view(np.uint8), axis=1, dtype=np.uint8 if k < 256 else np.uint32) > 1)
        least = np.einsum("pkd,pd->pk", w.reshape(-1, k, w.shape[1])[model], one[row]).argmin(axis=1)
        hot[model, :, row] = False
        hot[model, least, row] = True
    return hot


def _slack(one: np.ndarray, far: float) -> np.ndarray | None:
    """Bound by row on twice the single-precision error of a row's squared distance (but for its own square) to a centre of squared
    length `far` at most; None where the numbers do not fit."""
    most = 2 * np.sqrt((one[:, :-1] ** 2).sum(axis=1) * far) + far
    return (2.0 ** -23 * (one.shape[1] + 8) * most + 1e-30).astype(np.float32) if most.max() < 1e30 else None


def _lloyd_stats(blocks, models) -> dict[int, np.ndarray]:
    """Unit -> [squared distance, rows per centre, sums per centre]. Models of the same k are compared tile by tile. The squared
    distance follows from the sums."""
    plans, total = {}, {}
    for group, mine in _by_group(models).items():
        tiles = []
        for k, at in _tiles([len(c) for _, c in mine]):
            c = np.vstack([mine[i][1] for i in at])
            w = np.column_stack([-2 * c, (c * c).sum(axis=1)])
            with np.errstate(over="ignore"):
                tiles.append((k, [mine[i][0] for i in at], w, w.astype(np.float32)))
        plans[group] = tiles, max(float(w[:, -1].max()) for _, _, w, _ in tiles)
    room = _Room()
    for group, x in _group_rows(blocks, plans):
        tiles, far = plans[group]
        one = np.column_stack([x, np.ones(len(x))])
        slack = _slack(one, far)
        with np.errstate(over="ignore"):
            one32 = np.ascontiguousarray(one.T, dtype=np.float32)
        if group not in total:
            total[group] = [0.0, *(np.zeros_like(w) for _, _, w, _ in tiles)]
        total[group][0] += float((x * x).sum())
        for (k, _, w, w32), sums in zip(tiles, total[group][1:]):
            hot = room.get("share", (len(w), len(x)))
            np.copyto(hot, _nearest_hot(k, w, w32, one, one32, slack, room).reshape(hot.shape))
            sums += hot @ one
    out = {}
    for group, (own, *sums) in total.items():
        for (k, units, w, _), v in zip(plans[group][0], sums):
            for j, unit in enumerate(units):
                s = v[j * k:(j + 1) * k]
                near = max(own + float((w[j * k:(j + 1) * k] * s).sum()), 0.0)
                out[unit] = np.concatenate([[near], s[:, -1], s[:, :-1].ravel()])
    return out


def kmeans_fits(table: DataFrame, specs: list[Spec], max_rounds: int = 300, tol: float = LLOYD_TOL,
                starts: dict[int, np.ndarray] | None = None) -> list[KMeansFit]:
    """Lloyd rounds of all models at once; a centre without rows stays where it is."""
    sample = starts or seed_rows(table, sorted({s.group for s in specs}))
    fits = [KMeansFit(s, plus_plus(sample[s.group], s.k, np.random.default_rng([s.seed, s.start, s.k, s.group if s.draw is None else s.draw])))
            for s in specs]
    width = {g: tol * float(x.var(axis=0).mean()) if len(x) else 0.0 for g, x in sample.items()}
    live = list(range(len(fits)))
    for _ in range(max_rounds):
        got = summed(table, _lloyd_stats, [(i, fits[i].spec.group, fits[i].centers) for i in live])
        still = []
        for i in live:
            f, v = fits[i], got[i]
            k, d = f.centers.shape
            n = v[1:1 + k]
            new = np.where(n[:, None] > 0, v[1 + k:].reshape(k, d) / np.maximum(n, 1)[:, None], f.centers)
            f.inertia, f.rounds = float(v[0]), f.rounds + 1
            if ((new - f.centers) ** 2).sum() > width[f.spec.group]:
                f.centers = new
                still.append(i)
        live = still
        if not live:
            break
    return fits


def best_of(fits: list[KMeansFit]) -> dict[tuple[int, int, int], KMeansFit]:
    """(group, k, seed) -> the start of least squared distance."""
    out: dict[tuple[int, int, int], KMeansFit] = {}
    for f in fits:
        key = (f.spec.group, f.spec.k, f.spec.seed)
        if key not in out or f.inertia < out[key].inertia:
            out[key] = f
    return out


# ---------------------------------------------------------------- mixtures

def log_joint(x: np.ndarray, m: Mixture) -> np.ndarray:
    """log(weight) + log density of every component (rows x k)."""
    k, d = m.means.shape
    y = (x @ m.factors.transpose(1, 0, 2).reshape(d, k * d)).reshape(len(x), k, d) - np.einsum("kd,kde->ke", m.means, m.factors)
    return np.log(m.weights) + m.log_dets - 0.5 * (d * LOG_2PI + (y * y).sum(axis=2))


def posterior(x: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities (rows x k) and log-likelihood of every row."""
    z = log_joint(x, m)
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total)).ravel()


def _quadratic(x: np.ndarray, room: _Room) -> np.ndarray:
    """1, x, upper half of x x^T; a column per row."""
    n, d = x.shape
    out = room.get("q", (1 + d + d * (d + 1) // 2, n))
    out[0] = 1
    out[1:1 + d] = x.T
    at = 1 + d
    for i in range(d):
        np.multiply(out[1 + i:1 + d], out[1 + i], out=out[at:at + d - i])
        at += d - i
    return out


def _forms(m: Mixture) -> np.ndarray:
    """log_joint as a linear form of _quadratic(x), a row per component."""
    k, d = m.means.shape
    iu = np.triu_indices(d)
    inverse = m.factors @ m.factors.transpose(0, 2, 1)
    linear = np.einsum("kde,ke->kd", inverse, m.means)
    const = np.log(m.weights) + m.log_dets - 0.5 * (d * LOG_2PI + (linear * m.means).sum(axis=1))
    return np.column_stack([const, linear, -inverse[:, iu[0], iu[1]] * np.where(iu[0] == iu[1], 0.5, 1.0)])


def _factor_pieces(some: list[Mixture]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Models of one k: constant by component, and for some columns at a time of the triangular factors (first, last, components x
    columns x [-mean, 1] @ factor): only the features up to the last one enter."""
    factors = np.concatenate([m.factors for m in some])
    shift = np.concatenate([np.einsum("kd,kde->ke", m.means, m.factors) for m in some])
    const = np.concatenate([np.log(m.weights) + m.log_dets for m in some]) - 0.5 * factors.shape[1] * LOG_2PI
    pieces = []
    for lo in range(0, factors.shape[1], FACTOR_COLUMNS):
        hi = min(lo + FACTOR_COLUMNS, factors.shape[1])
        pieces.append((lo, hi, np.concatenate([-shift[:, lo:hi, None], factors[:, :hi, lo:hi].transpose(0, 2, 1)], axis=2)))
    return const, pieces


def _log_joints(q: np.ndarray, const: np.ndarray, pieces: list[tuple[int, int, np.ndarray]], room: _Room) -> np.ndarray:
    """As `log_joint` for the components of several models (components x rows), a few components at a time."""
    n = q.shape[1]
    z = room.get("z", (len(const), n))
    z[...] = 0.0
    step = max(1, 2 * TILE // (n * FACTOR_COLUMNS))
    for lo, hi, w in pieces:
        for a in range(0, len(w), step):
            some = w[a:a + step].reshape(-1, 1 + hi)
            y = np.matmul(some, q[:1 + hi], out=room.get("y", (len(some), n)))
            np.multiply(y, y, out=y)
            z[a:a + step] += y.reshape(-1, hi - lo, n).sum(axis=1)
    z *= -0.5
    z += const[:, None]
    return z


def _responsibilities(z: np.ndarray, k: int) -> np.ndarray:
    """Log densities (models * k x rows) become responsibilities in place; log-likelihood of every model."""
    part = z.reshape(-1, k, z.shape[1])
    top = part.max(axis=1)
    part -= top[:, None, :]
    np.exp(part, out=part)
    total = part.sum(axis=1)
    part *= (1 / total)[:, None, :]
    return (top + np.log(total)).sum(axis=1)


def _em_stats(blocks, models) -> dict[int, np.ndarray]:
    """Unit -> [log-likelihood, rows, sum r, sum r x, sum r x x^T (upper half)]; a model given by centres counts the nearest one.
    Models of the same k are scored tile by tile; with few features log densities are one product with the rows' quadratic terms."""
    plans, total = {}, {}
    for group, mine in _by_group(models).items():
        parts = []
        for k, at in _tiles([m.k if isinstance(m, Mixture) else -len(m) for _, m in mine]):
            some = [mine[i][1] for i in at]
            if k < 0:
                c = np.vstack(some)
                w = np.column_stack([(c * c).sum(axis=1), -2 * c])
            else:
                w = np.vstack([_forms(m) for m in some]) if some[0].means.shape[1] <= FORM_FEATURES else _factor_pieces(some)
            parts.append((k, [mine[i][0] for i in at], w))
        d = (some[0].means if isinstance(some[0], Mixture) else some[0]).shape[1]
        plans[group] = d, parts
    room = _Room()
    for group, x in _group_rows(blocks, plans):
        d, parts = plans[group]
        q = _quadratic(x, room)
        if group not in total:
            total[group] = [0, *([np.zeros((abs(k) * len(units), len(q))), np.zeros(len(units))] for k, units, _ in parts)]
        total[group][0] += len(x)
        for (k, units, w), (sums, ll) in zip(parts, total[group][1:]):
            if k < 0:
                part = (w @ q[:1 + d]).reshape(len(units), -k, len(x))
                r = np.zeros_like(part)
                np.put_along_axis(r, part.argmin(axis=1)[:, None, :], 1.0, axis=1)      # the first of equally near centres
                r = r.reshape(-1, len(x))
            else:
                r = _log_joints(q, *w, room) if isinstance(w, tuple) else np.matmul(w, q, out=room.get("z", (len(w), len(x))))
                ll += _responsibilities(r, k)
            sums += r @ q.T
    out = {}
    for group, (rows, *got) in total.items():
        d, parts = plans[group]
        for (k, units, _), (sums, ll) in zip(parts, got):
            for j, unit in enumerate(units):
                s = sums[j * abs(k):(j + 1) * abs(k)]
                out[unit] = np.concatenate([[ll[j], rows], s[:, 0], s[:, 1:1 + d].ravel(), s[:, 1 + d:].ravel()])
    return out


def _step(v: np.ndarray, k: int, d: int, reg: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means, factors from the sums."""
    n = v[2:2 + k] + 10 * np.finfo(float).eps
    means = v[2 + k:2 + k + k * d].reshape(k, d) / n[:, None]
    iu = np.triu_indices(d)
    cov = np.zeros((k, d, d))
    cov[:, iu[0], iu[1]] = v[2 + k + k * d:].reshape(k, -1) / n[:, None]
    cov = cov + np.triu(cov, 1).transpose(0, 2, 1) - means[:, :, None] * means[:, None, :]
    factors = np.empty_like(cov)
    for i in range(k):
        jitter = reg
        while True:
            try:
                low = np.linalg.cholesky(cov[i] + jitter * np.eye(d))
                break
            except np.linalg.LinAlgError:
                jitter *= 10
        factors[i] = np.linalg.inv(low).T
    return n / n.sum(), means, factors


def mixture_fits(table: DataFrame, specs: list[Spec], max_rounds: int = 500, tol: float = EM_TOL, reg: float = REG_COVAR) -> list[Mixture]:
    """EM of all models at once from K-means assignments, one scan a round."""
    centers = kmeans_fits(table, specs, INIT_ROUNDS)
    got = summed(table, _em_stats, [(i, f.spec.group, f.centers) for i, f in enumerate(centers)])
    fits = []
    for i, f in enumerate(centers):
        k, d = f.centers.shape
        fits.append(Mixture(*_step(got[i], k, d, reg), spec=f.spec, rows=int(got[i][1])))
    live = list(range(len(fits)))
    for _ in range(max_rounds):
        got = summed(table, _em_stats, [(i, fits[i].spec.group, fits[i]) for i in live])
        still = []
        for i in live:
            m, v = fits[i], got[i]
            before = m.log_likelihood
            m.log_likelihood, m.rounds = float(v[0]), m.rounds + 1       # of the parameters m has now
            m.history.append(m.log_likelihood)
            if abs(m.log_likelihood - before) / m.rows < tol or m.rounds >= max_rounds:
                continue
            m.weights, m.means, m.factors = _step(v, *m.means.shape, reg)
            still.append(i)
        live = still
        if not live:
            break
    return fits


def best_starts(fits: list[Mixture]) -> dict[tuple[int, int, int], Mixture]:
    """(group, k, seed) -> the start of greatest likelihood."""
    out: dict[tuple[int, int, int], Mixture] = {}
    for m in fits:
        key = (m.spec.group, m.spec.k, m.spec.seed)
        if key not in out or m.log_likelihood > out[key].log_likelihood:
            out[key] = m
    return out


def grid(ks, seeds, starts: int, groups=(0,)) -> list[Spec]:
    return [Spec(k, s, i, g) for g in groups for k in ks for s in seeds for i in range(starts)]


# ---------------------------------------------------------------- scoring

def posteriors(table: DataFrame, models: dict[int, Mixture], keys: list[str], log_likelihood: bool = False) -> DataFrame:
    """keys, _g, _p (posterior of the model of the row's group; null where the group has none) [, _ll]."""
    held = table.sparkSession.sparkContext.broadcast(models)
    schema = table.select(*keys, "_g").schema.add("_p", ArrayType(DoubleType()))
    if log_likelihood:
        schema = schema.add("_ll", DoubleType())

    def run(batches):
        for part, g, x in _blocks(batches):
            p: list = [None] * len(x)
            ll = np.full(len(x), np.nan)
            for group in np.unique(g):
                m = held.value.get(int(group))
                if m is None:
                    continue
                at = np.flatnonzero(g == group)
                r, ll[at] = posterior(x[at], m)
                for i, row in zip(at.tolist(), r.tolist()):
                    p[i] = row
            cols = [part.column(c) for c in [*keys, "_g"]] + [pa.array(p, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ll)] if log_likelihood else []),
                                             names=[*keys, "_g", "_p", *(["_ll"] if log_likelihood else [])])

    return table.select(*keys, "_g", "_x").mapInArrow(run, schema)
