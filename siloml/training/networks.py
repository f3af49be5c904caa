"""One-hidden-layer networks of all silos: back-propagated gradient sums, limited-memory quasi-Newton steps.

A vector holds w1 (inputs x hidden), w2 (hidden), b1 (hidden) and b2, in this order. Hidden units are rectified, the
output is logistic. A pass over the rows is one job for all silos (``iterate``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from siloml.functions.blocks import map_with_side
from siloml.operators.params import flatten_params, rebuild_params, shape_params
from siloml.spec import CLIENT, FEATURES, LABEL, SPLIT, MlpSpec
from siloml.training.iterate import fit_silos

PAIRS = 10  # steps that the quasi-Newton direction remembers
CALM = 10  # accepted steps in a row that gain less than tol end a fit


def n_weights(width: int, hidden: int) -> int:
    return width * hidden + 2 * hidden + 1


def start_weights(width: int, hidden: int, seed: int) -> np.ndarray:
    """Uniform start inside +-sqrt(6 / (fan in + fan out)) of each layer, biases too; the same in every silo."""
    rng = np.random.default_rng(seed)
    first, second = np.sqrt(6.0 / (width + hidden)), np.sqrt(6.0 / (hidden + 1))
    return np.concatenate([
        rng.uniform(-first, first, width * hidden), rng.uniform(-second, second, hidden),
        rng.uniform(-first, first, hidden), rng.uniform(-second, second, 1)])


def logistic(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * m))  # without overflow


def layers(vector: np.ndarray, width: int, hidden: int):
    cut = width * hidden
    return vector[:cut].reshape(width, hidden), vector[cut:cut + hidden], vector[cut + hidden:cut + 2 * hidden], vector[-1]


def margins(vector: np.ndarray, x: np.ndarray, hidden: int) -> np.ndarray:
    w1, w2, b1, b2 = layers(vector, x.shape[1], hidden)
    return np.maximum(x @ w1 + b1, 0.0) @ w2 + b2


def curved(grad, pairs):
    """The inverse curvature of the remembered pairs times the gradient, by two loops over them."""
    q, moves, changes = grad.copy(), *pairs
    scale = 1.0 / np.einsum("ij,ij->i", moves, changes) if len(moves) else np.zeros(0)
    a = np.zeros(len(moves))
    for i in range(len(moves) - 1, -1, -1):
        a[i] = scale[i] * (moves[i] @ q)
        q -= a[i] * changes[i]
    if len(moves):
        q *= (moves[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for i in range(len(moves)):
        q += (a[i] - scale[i] * (changes[i] @ q)) * moves[i]
    return q


class Network:
    """Mean log loss plus alpha / 2n times the squared weights (biases are free), all rows in a step.

    The memory of a silo: [pairs, loss, step, calm steps, accepted], the best vector, its gradient, the direction,
    then PAIRS moves and PAIRS gradient changes, the latest last.
    """

    def __init__(self, spec: MlpSpec, width: int):
        self.spec, self.width, self.size = spec, width, n_weights(width, spec.hidden)
        self.weights = self.size - spec.hidden - 1

    def statistic(self, vector, x, y, w):
        """[rows, loss, gradient] sums."""
        w1, w2, b1, b2 = layers(vector, self.width, self.spec.hidden)
        h = np.maximum(x @ w1 + b1, 0.0)
        m = h @ w2 + b2
        slope = w * (logistic(m) - y)
        back = np.outer(slope, w2) * (h > 0)
        loss = float(w @ (np.logaddexp(0.0, m) - y * m))
        return np.concatenate([[w.sum(), loss], (x.T @ back).ravel(), h.T @ slope, back.sum(axis=0), [slope.sum()]])

    def objective(self, vector, sums) -> tuple[float, np.ndarray]:
        n, shrunk = sums[0], self.spec.alpha * vector
        shrunk[self.weights:] = 0.0
        return float(sums[1] + 0.5 * shrunk @ vector) / n, (sums[2:] + shrunk) / n

    def advance(self, vector, memory, sums):
        d, spec = self.size, self.spec
        loss, grad = self.objective(vector, sums)
        if not len(memory):
            head, pairs = np.asarray([0.0, loss, 0.0, 0.0, 0.0]), np.zeros((2, 0, d))
        else:
            head = memory[:5].copy()
            best, old, direction = memory[5:5 + 3 * d].reshape(3, d)
            pairs = memory[5 + 3 * d:].reshape(2, -1, d)
            if loss > head[1] + 1e-4 * head[2] * (old @ direction):  # not enough of a fall: half the step
                head[2] /= 2
                ended = head[2] < 1e-10
                return best + head[2] * direction, np.concatenate([head, memory[5:]]), ended, float(np.abs(old).max())
            head[3] = head[3] + 1 if head[1] - loss < spec.tol else 0
            move, change = vector - best, grad - old
            if move @ change > 1e-10 * (change @ change):
                pairs = np.concatenate([pairs, np.stack([move, change])[:, None]], axis=1)[:, -PAIRS:]
            head[1] = loss
            head[4] += 1
        direction = -curved(grad, pairs)
        # Without pairs the direction is the gradient, whose length says nothing about a step.
        head[2] = 1.0 if pairs.shape[1] else min(1.0, 1.0 / max(1e-12, float(np.linalg.norm(grad))))
        head[0] = pairs.shape[1]
        ended = head[3] >= CALM or float(np.abs(grad).max()) < 1e-9
        kept = np.concatenate([head, vector, grad, direction, pairs.ravel()])
        return vector + head[2] * direction, kept, ended, float(np.abs(grad).max())

    def best(self, vector, memory):
        return memory[5:5 + self.size] if len(memory) else vector


class Descent(Network):
    """Plain gradient steps of size ``lr`` on the same objective, one a pass; nothing is remembered."""

    def __init__(self, spec: MlpSpec, width: int, lr: float):
        super().__init__(spec, width)
        self.lr = lr

    def advance(self, vector, memory, sums):
        _, grad = self.objective(vector, sums)
        return vector - self.lr * grad, memory, False, float(np.abs(grad).max())

    def best(self, vector, memory):
        return vector


def descend_mlp(df: DataFrame, spec: MlpSpec, width: int, start: DataFrame | np.ndarray, lr: float, steps: int = 1) -> DataFrame:
    """All silos' networks after ``steps`` full-batch gradient steps from ``start``, as ``fit_mlp`` returns them."""
    rows = df.select(CLIENT, SPLIT, LABEL, FEATURES, F.lit(1.0).alias("sample_weight"))
    return fit_silos(rows, Descent(spec, width, lr), start, steps)


def fit_mlp(df: DataFrame, spec: MlpSpec, width: int, start: DataFrame | np.ndarray | None = None, steps: int | None = None) -> DataFrame:
    """Networks of all silos (contract columns + features): (client_id, vector, status, passes, residual).

    ``start``: a vector for all silos or (client_id, vector); the seeded start if None. A fit ends after ten steps in a
    row that lower the loss by less than ``tol``, or after ``max_iter`` passes (``steps``, if given), whose network counts as
    fitted. Silos without training rows or with non-finite values say so in their status.
    """
    start = start_weights(width, spec.hidden, spec.seed) if start is None else start
    rows = df.select(CLIENT, SPLIT, LABEL, FEATURES, F.lit(1.0).alias("sample_weight"))
    return fit_silos(rows, Network(spec, width), start, spec.max_iter if steps is None else steps + 1)


def mlp_table(fits: DataFrame, width: int, hidden: int, round_no: int) -> DataFrame:
    """Long parameter rows, layers w1 (0), w2 (1), b1 (2), b2 (3)."""
    flat = flatten_params(fits.select(F.lit(round_no).alias("round"), CLIENT, "vector"))
    return shape_params(flat, width, hidden, 1)


def predict_mlp(df: DataFrame, params: DataFrame, width: int, hidden: int, n_silos: int, shared: bool = False) -> DataFrame:
    """Add ``prob`` and ``pred`` of the silos' networks, or of one ``shared`` network, given as parameter rows."""
    if shared:
        model = rebuild_params(params.withColumn("_one", F.lit(1)), ["_one"])
        vectors = df.select(CLIENT).distinct().withColumn("_one", F.lit(1)).join(F.broadcast(model), "_one")
    else:
        vectors = rebuild_params(params, [CLIENT])

    def score(vector, x):
        prob = logistic(margins(np.asarray(vector), x, hidden))
        return prob, (prob > 0.5).astype(np.int32)

    return map_with_side(df, vectors, "vector", score, "prob double, pred int", n_silos, 8 * n_weights(width, hidden) + 64)
