"""Gaussian-process acquisition: the factor of the few measured rows is computed once and sent to the candidates.

Candidates, the side that grows, are scored in Arrow batches. The exact factor does not depend on the outcomes, so all fantasy worlds share
it and differ in one column of weights. It needs all measured rows at once: up to ``max_rows`` of them are factored on the driver.

Beyond that the kernel is replaced by random Fourier features, drawn from a seed: a Bayesian linear model whose normal equations
are one distributed sum over the measured rows and one over the pending ones, of a size that ``features`` sets and rows do not.
Fantasies are then draws of the model's weights. The kernel's error falls as 1 / sqrt(features).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.operators.selection import dpp
from candela.operators.staging import staged

MAX_ROWS, FEATURES = 5_000, 1_024
NOISE, JITTER, SPARE = 1e-4, 1e-6, 1e-4
_erf = np.frompyfunc(math.erf, 1, 1)


def kernel(a: np.ndarray, b: np.ndarray, scale: float = 1.0, variance: float = 1.0) -> np.ndarray:
    sq = np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2.0 * a @ b.T)
    return variance * np.exp(-0.5 / scale**2 * sq)


def _factor(k: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(k + SPARE * np.eye(len(k)))


def _weights(factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.solve(factor.T, np.linalg.solve(factor, y))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, weights) of the measured rows."""
    if not len(x):
        raise ValueError("the measured rows must not be empty")
    factor = _factor(kernel(x, x) + (NOISE + JITTER) * np.eye(len(x)))
    return factor, _weights(factor, y)


def predict(x: np.ndarray, factor: np.ndarray, weights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, variance) at the rows of ``at``; weights may have a column a world."""
    k = kernel(x, at)
    return k.T @ weights, np.maximum(1e-10, 1.0 - (np.linalg.solve(factor, k) ** 2).sum(0))


def fantasies(x, factor, weights, pending, worlds: int, seed: int) -> np.ndarray:
    """(worlds, pending) joint draws of the pending outcomes."""
    k = kernel(x, pending)
    v = np.linalg.solve(factor, k)
    root = _factor(kernel(pending, pending) - v.T @ v + JITTER * np.eye(len(pending)))
    return (k.T @ weights)[None] + np.random.default_rng(seed).standard_normal((worlds, len(pending))) @ root.T


def expected_improvement(mean, variance, best, xi: float = 0.01):
    sigma = np.sqrt(np.maximum(1e-10, variance))
    gain = mean - best - xi
    z = gain / sigma
    return np.maximum(0.0, gain * 0.5 * (1.0 + _erf(z / math.sqrt(2)).astype(float)) + sigma * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi))


def frequencies(dimensions: int, features: int, seed: int, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The random Fourier features of the kernel: (directions, phases)."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dimensions, features)) / scale, rng.uniform(0, 2 * math.pi, features)


def mapped(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return math.sqrt(2 / len(phases)) * np.cos(x @ directions + phases)


def _vectors(column, dimensions: int) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float) if len(column) else np.zeros((0, dimensions))


def normal_equations(rows: DataFrame, basis: tuple[np.ndarray, np.ndarray], vector_col: str, outcome_col: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sum of phi phi', sum of phi y) over all rows: a task sums what it reads, then rows of the matrices are summed by their number."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)
    n = len(basis[1])

    def partial(batches):
        directions, phases = sent.value
        total = np.zeros((n, n + 1))
        for b in batches:
            phi = mapped(_vectors(b.column(0), len(directions)), directions, phases)
            y = np.asarray(b.column(1), float) if outcome_col else np.zeros(len(phi))
            total += phi.T @ np.column_stack((phi, y))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), n + 1).cast(pa.list_(pa.float64()))], names=["i", "v"])

    def summed(table):
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([np.sum(np.stack(table.column("v").to_numpy()), axis=0)], pa.list_(pa.float64()))})

    parts = rows.select(F.col(vector_col).cast("array<double>"), *([F.col(outcome_col).cast("double")] if outcome_col else [])).mapInArrow(partial, "i int, v array<double>")
    out = np.zeros((n, n + 1))
    for r in parts.groupBy("i").applyInArrow(summed, "i int, v array<double>").collect():  # features x features numbers
        out[r["i"]] = r["v"]
    return out[:, :n], out[:, n]


def _kept(rows: DataFrame | None, most: int) -> bool:
    return rows is None or rows.limit(most + 1).count() <= most


def acquisition(candidates: DataFrame, measured: DataFrame, pending: DataFrame | None = None, *, vector_col: str = "x", outcome_col: str = "y", kind: str = "EI", worlds: int = 32, xi: float = 0.01, kappa: float = 2.0, seed: int, max_rows: int = MAX_ROWS, features: int = FEATURES) -> DataFrame:
    """``candidates`` with mean, variance (of the measured model) and acquisition, averaged over the worlds if rows are pending.

    Up to ``max_rows`` measured and as many pending rows give the exact posterior; more give that of ``features`` random features."""
    if _kept(measured, max_rows) and _kept(pending, max_rows):
        model = _exact(measured, pending, vector_col, outcome_col, worlds, seed)
    else:
        model = _featured(measured, pending, vector_col, outcome_col, worlds, seed, features)
    sent = candidates.sparkSession.sparkContext.broadcast(model)
    names = candidates.columns

    def score(batches):
        posterior, best = sent.value
        for b in batches:
            mean, var, mu, v = posterior(b.column(vector_col))
            each = mu + kappa * np.sqrt(v)[:, None] if kind.upper() == "UCB" else expected_improvement(mu, v[:, None], best[None], xi)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mean), pa.array(var), pa.array(each.mean(1))], names=[*names, "mean", "variance", "acquisition"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", mean double, variance double, acquisition double"
    return candidates.mapInArrow(score, schema)


class ExactPosterior:
    """(mean, variance, means of the worlds, their variance) at given vectors. The factors' inverses are worked out once, not a batch."""

    def __init__(self, base, world):
        self.base, self.world = ((x, np.linalg.inv(factor), weights) for x, factor, weights in (base, world))

    def __call__(self, column):
        at = _vectors(column, self.base[0].shape[1])
        return *self.at(*self.base, at), *self.at(*self.world, at)

    @staticmethod
    def at(x, inverse, weights, at):
        k = kernel(x, at)
        return k.T @ weights, np.maximum(1e-10, 1.0 - ((inverse @ k) ** 2).sum(0))


def _exact(measured, pending, vector_col, outcome_col, worlds, seed):
    got = measured.select(vector_col, outcome_col).collect()
    x, y = np.array([r[0] for r in got], float), np.array([r[1] for r in got], float)
    factor, weights = fit(x, y)
    p = np.array([r[0] for r in pending.select(vector_col).collect()], float) if pending is not None else np.zeros((0, 0))
    if not len(p):
        return ExactPosterior((x, factor, weights), (x, factor, weights[:, None])), np.array([y.max()])
    draws = fantasies(x, factor, weights, p, worlds, seed)
    xs, ys = np.vstack([x, p]), np.hstack([np.repeat(y[None], worlds, 0), draws])
    return ExactPosterior((x, factor, weights), (xs, *fit(xs, ys.T))), ys.max(1)


class FeaturePosterior:
    """The same from random features: weights and the inverse of the normal equations' factor."""

    def __init__(self, basis, base, world):
        self.basis, self.base, self.world = basis, *((weights, np.linalg.inv(factor)) for weights, factor in (base, world))

    def __call__(self, column):
        phi = mapped(_vectors(column, len(self.basis[0])), *self.basis)
        spread = lambda inverse: np.maximum(1e-10, (NOISE + JITTER) * ((inverse @ phi.T) ** 2).sum(0))
        return phi @ self.base[0], spread(self.base[1]), phi @ self.world[0], spread(self.world[1])


def _featured(measured, pending, vector_col, outcome_col, worlds, seed, features):
    dimensions = len(measured.select(vector_col).first()[0])
    basis, noise = frequencies(dimensions, features, seed), NOISE + JITTER
    gram, right = normal_equations(measured, basis, vector_col, outcome_col)
    best = np.array([measured.agg(F.max(outcome_col)).first()[0]], float)
    factor = _factor(gram + noise * np.eye(features))
    mean = _weights(factor, right)
    base = (mean, factor)
    if pending is None or pending.isEmpty():
        return FeaturePosterior(basis, base, (mean[:, None], factor)), best
    draws = mean[:, None] + math.sqrt(noise) * np.linalg.solve(factor.T, np.random.default_rng(seed).standard_normal((features, worlds)))
    sent = measured.sparkSession.sparkContext.broadcast((basis, draws))

    def highest(batches):
        (directions, phases), w = sent.value
        top = None
        for b in batches:
            if b.num_rows:
                here = (mapped(_vectors(b.column(0), len(directions)), directions, phases) @ w).max(0)
                top = here if top is None else np.maximum(top, here)
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(top), dtype=np.int32)), pa.array(top)], names=["world", "top"])

    tops = pending.select(F.col(vector_col).cast("array<double>")).mapInArrow(highest, "world int, top double").groupBy("world").agg(F.max("top")).collect()  # a row a world
    added, _ = normal_equations(pending, basis, vector_col, None)
    both = _factor(gram + added + noise * np.eye(features))
    world = _weights(both, right[:, None] + added @ draws)  # a world's pending outcomes are phi'w, so they add (sum of phi phi') w
    return FeaturePosterior(basis, base, (world, both)), np.maximum(best, np.array([t for _, t in sorted(map(tuple, tops))]))


def outcome(df: DataFrame, *, names: tuple[str, ...] = ("potency", "overall_score", "manufacturability_score"), default: float = 50.0) -> Column:
    """The first of the named columns that ``df`` has and that isn't null, else the default: a candidate's measured quality."""
    return F.coalesce(*(F.col(c).cast("double") for c in names if c in df.columns), F.lit(default))


def propose(candidates: DataFrame, measured: DataFrame, pending: DataFrame | None = None, *, batch_size: int = 10, use_dpp: bool = True, temperature: float = 10.0, gamma: float | None = None, id_col: str = "candidate_id", **how) -> DataFrame:
    """The next batch: acquisition as quality of a determinantal point process, or the best by acquisition. Measured rows without the
    outcome column count their ``outcome``."""
    name = how.get("outcome_col", "y")
    a = acquisition(candidates, measured if name in measured.columns else measured.withColumn(name, outcome(measured)), pending, **how)
    if not use_dpp:
        return a.orderBy(F.desc("acquisition"), id_col).limit(batch_size).select(id_col, "acquisition")
    vector = how.get("vector_col", "x")
    a = staged(a.select(id_col, vector, "acquisition"), "acquisition")  # the batch's passes read it again and again
    return dpp.select_batch(a, batch_size, order_col=id_col, vector_col=vector, quality_col="acquisition", temperature=temperature, gamma=gamma)
