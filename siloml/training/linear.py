"""L1 logistic regression and squared-hinge SVM for all silos at once.

A pass sums loss, gradient and Hessian of every silo (numpy over blocks of rows in the tasks), and each silo takes
its damped Newton step in a task; the steps' state is a table (``iterate``), so any number of silos can be fitted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from siloml.functions.joins import attach, group_count
from siloml.functions.vectors import dot, sigmoid
from siloml.operators.params import linear_table, rebuild_params
from siloml.operators.silos import class_weights
from siloml.spec import CLIENT, FEATURES, LABEL, SPLIT, TRAIN, LogisticSpec, SvcSpec
from siloml.training.iterate import NOT_CONVERGED, OK, fit_silos, require_fitted


def _soft(v, t):
    return np.sign(v) * max(abs(v) - t, 0.0)


def _l1_step(w, g, h, penalty, sweeps=200):
    """Minimise g'd + d'Hd/2 + sum penalty_i |w_i + d_i| by coordinate descent; returns w + d."""
    z = w.copy()
    grad = g.copy()  # gradient of the quadratic at z
    diag = np.maximum(np.diag(h), 1e-12)
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(w)):
            new = _soft(z[i] - grad[i] / diag[i], penalty[i] / diag[i])
            if new != z[i]:
                step = new - z[i]
                grad += h[:, i] * step
                moved = max(moved, abs(step) * np.sqrt(diag[i]))
                z[i] = new
        if moved < 1e-10:
            break
    return z


class Newton:
    """Damped Newton steps of one silo. Memory: [objective, residual], then the best [w..., b]."""

    def __init__(self, spec: LogisticSpec | SvcSpec, width: int):
        self.spec, self.size = spec, width + 1
        self.penalty = np.ones(self.size)
        self.penalty[-1] = 1.0 if spec.penalise_intercept else 0.0

    def statistic(self, vector, x, y, w):
        """[rows, loss, gradient, upper triangle of the Hessian] sums."""
        x1 = np.hstack([x, np.ones((len(x), 1))])
        m = x1 @ vector
        if self.spec.family == "logistic":
            p = 1.0 / (1.0 + np.exp(-m))
            loss, slope, curve = np.logaddexp(0.0, m) - y * m, p - y, p * (1.0 - p)
        else:
            s = 2.0 * y - 1.0
            short = np.maximum(0.0, 1.0 - s * m)
            loss, slope, curve = short ** 2, -2.0 * s * short, 2.0 * (short > 0)
        hessian = (x1 * (w * curve)[:, None]).T @ x1
        return np.concatenate([[len(x), float(w @ loss)], x1.T @ (w * slope), hessian[np.triu_indices(self.size)]])

    def advance(self, vector, memory, sums):
        spec, d, w, l1 = self.spec, self.size, vector, self.spec.family == "logistic"
        g, h = spec.C * sums[2:2 + d], np.zeros((d, d))
        h[np.triu_indices(d)] = spec.C * sums[2 + d:]
        h += np.triu(h, 1).T
        value = spec.C * sums[1] + (np.abs(w) @ self.penalty if l1 else 0.5 * (w * w) @ self.penalty)
        if len(memory) and value > memory[0] + 1e-12 * abs(memory[0]):  # overshoot: halve the step
            trial = memory[2:] + 0.5 * (w - memory[2:])
            return trial, memory, bool(np.max(np.abs(trial - memory[2:])) < 1e-12), float(memory[1])
        if l1:
            at_zero = np.maximum(np.abs(g) - self.penalty, 0.0)
            residual = np.where(w != 0, np.abs(g + np.sign(w) * self.penalty), at_zero)
        else:
            grad = g + w * self.penalty
            residual = np.abs(grad)
        residual = float(residual.max()) / max(1.0, spec.C * sums[0])
        kept = np.concatenate([[value, residual], w])
        if residual < spec.tol:
            return w, kept, True, residual
        if l1:
            target = _l1_step(w, g, h + 1e-10 * np.eye(d), self.penalty)
        else:
            target = w - np.linalg.solve(h + np.diag(self.penalty) + 1e-12 * np.eye(d), grad)
        return target, kept, False, residual

    def best(self, vector, memory):
        return memory[2:] if len(memory) else vector


def weighted_rows(df: DataFrame, balanced: bool, n_silos: int) -> DataFrame:
    """Rows as (client_id, split, label, features, sample_weight); weights are those of the training rows' classes."""
    if not balanced:
        return df.select(CLIENT, SPLIT, LABEL, FEATURES, F.lit(1.0).alias("sample_weight"))
    weights = class_weights(df).select(CLIENT, LABEL, F.col("weight").alias("sample_weight"))
    return attach(df, weights, [CLIENT, LABEL], 2 * n_silos, 64, how="left").select(
        CLIENT, SPLIT, LABEL, FEATURES, "sample_weight")


def fit_linear(
    df: DataFrame,
    spec: LogisticSpec | SvcSpec,
    width: int,
    start: DataFrame | np.ndarray | None = None,
    steps: int | None = None,
    round_no: int = 1,
    n_silos: int | None = None,
    strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Fit every silo of a staged frame (contract columns + features).

    ``start``: a vector [w..., b] for all silos, or (client_id, vector); zero if None. ``steps`` limits the Newton steps
    (None: to convergence). Returns the parameter table and the fits (client_id, vector, status, passes, residual), where
    the residual is that of the optimality condition. A silo that has no training rows, holds non-finite values or is
    not optimal after ``max_iter`` passes says so in its status; with ``strict`` it is an error.
    """
    n_silos = group_count(df, [CLIENT]) if n_silos is None else n_silos
    rows = weighted_rows(df, spec.balanced, n_silos)
    start = np.zeros(width + 1) if start is None else start
    fits = fit_silos(rows, Newton(spec, width), start, spec.max_iter if steps is None else steps + 1,
                     NOT_CONVERGED if steps is None else OK)
    if strict:
        require_fitted(fits)
    return linear_table(fits, width, round_no), fits


def linear_margin(df: DataFrame, params: DataFrame, width: int, n_silos: int, shared: bool = False,
                  keep_vector: bool = False) -> DataFrame:
    """Add ``margin`` = w.x + b from the parameters of the row's silo (or one shared model)."""
    if shared:
        vector = rebuild_params(params.withColumn("_one", F.lit(1)), ["_one"])
        joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(vector), "_one").drop("_one")
    else:
        vector = rebuild_params(params, [CLIENT])
        joined = attach(df, vector, [CLIENT], n_silos, 8 * width + 64, how="left")
    margin = dot(F.col(FEATURES), F.col("vector"), width) + F.get("vector", F.lit(width))
    scored = joined.withColumn("margin", margin)
    return scored if keep_vector else scored.drop("vector")


def predict_linear(df: DataFrame, params: DataFrame, width: int, n_silos: int, shared: bool = False) -> DataFrame:
    """Add ``margin``, ``prob`` and the hard class ``pred``."""
    scored = linear_margin(df, params, width, n_silos, shared)
    return scored.withColumn("prob", sigmoid(F.col("margin"))).withColumn("pred", (F.col("margin") > 0).cast("int"))


def gradient_step(
    df: DataFrame, width: int, lr: float, round_no: int = 1, start: DataFrame | None = None, shared: bool = False,
    n_silos: int | None = None,
) -> DataFrame:
    """Parameters after one full-batch logistic gradient step, all silos in one aggregation.

    ``start``: parameters to step from, the silos' own or one ``shared`` model (None: zero, where every
    probability is 1/2).
    """
    train = df.where(F.col(SPLIT) == TRAIN)
    if start is None:
        residual, old = F.col(LABEL) - F.lit(0.5), lambda i: F.lit(0.0)
    else:
        train = linear_margin(train, start, width, n_silos or 1, shared, keep_vector=True)
        residual, old = F.col(LABEL) - sigmoid(F.col("margin")), lambda i: F.first(F.get("vector", F.lit(i)))
    sums = train.groupBy(CLIENT).agg(
        F.array(*[old(i) + F.avg(residual * F.get(FEATURES, F.lit(i))) * lr for i in range(width)]).alias("w"),
        F.array(old(width) + F.avg(residual) * lr).alias("b"),
    )
    layers = F.array(F.col("w"), F.col("b"))
    return sums.select(CLIENT, F.posexplode(layers).alias("layer", "vector")).select(
        F.lit(round_no).alias("round"), CLIENT, "layer", F.posexplode("vector").alias("pos", "value")
    )
