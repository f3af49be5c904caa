"""Trainers against plain numpy on small silos, and the rounds built from them."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from siloml.functions.staging import stage
from siloml.operators import merge as M, params as P
from siloml.plans.prepare import Prepared, stack_runs
from siloml.plans import rounds as R
from siloml.spec import BoostSpec, ForestSpec, LogisticSpec, MlpSpec, RoundSpec, SvcSpec
from siloml.training import boost as B, forest as FO, linear as L, networks as N


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows, keep = [], {}
    for c, n in enumerate((420, 150)):
        x = rng.normal(size=(n, 3))
        y = (x @ [1.5, -1.0, 0.0] + rng.normal(scale=0.7, size=n) + c > 0.8).astype(int)
        split = np.where(np.arange(n) % 10 < 7, "train", np.where(np.arange(n) % 10 < 9, "test", "val"))
        keep[c] = (x, y, split == "train")
        rows += [(len(rows) + i, c, str(split[i]), int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, client_id int, split string, label int, features array<double>")
    return Prepared(stage(df.repartition(5)), ("a", "b", "c"), 2), keep


def fitted(df, spec, width=3):
    """{silo: residual} and {silo: weights} of a linear fit."""
    fits = L.fit_linear(df, spec, width)[1].collect()
    return {r.client_id: r.residual for r in fits}, {r.client_id: np.array(r.vector) for r in fits}


def test_logistic_is_optimal(data):
    prepared, keep = data
    spec = LogisticSpec(C=0.5)
    residual, w = fitted(prepared.df, spec)
    for c, (x, y, tr) in keep.items():
        x1 = np.hstack([x[tr], np.ones((tr.sum(), 1))])
        g = spec.C * x1.T @ (1 / (1 + np.exp(-x1 @ w[c])) - y[tr])
        nonzero = w[c] != 0
        assert np.all(np.abs(g[nonzero] + np.sign(w[c][nonzero])) < 1e-3)
        assert np.all(np.abs(g[~nonzero]) <= 1 + 1e-3)
        assert residual[c] < spec.tol


def test_strong_penalty_gives_zeros(data):
    _, w = fitted(data[0].df, LogisticSpec(C=1e-5))
    assert all(np.all(v == 0) for v in w.values())


def test_svc_gradient_vanishes(data):
    prepared, keep = data
    spec = SvcSpec(C=2.0)
    _, w = fitted(prepared.df, spec)
    for c, (x, y, tr) in keep.items():
        x1, s = np.hstack([x[tr], np.ones((tr.sum(), 1))]), 2.0 * y[tr] - 1
        n = np.array([np.sum(s < 0), np.sum(s > 0)])
        sw = np.where(s > 0, len(s) / (2 * n[1]), len(s) / (2 * n[0]))
        short = np.maximum(0, 1 - s * (x1 @ w[c]))
        assert np.max(np.abs(w[c] - 2 * spec.C * x1.T @ (sw * s * short))) < 1e-3


def test_states_without_a_broadcast_give_the_same_fit(data, monkeypatch):
    """Beyond the byte bound the silos' vectors meet the blocks by a salted join."""
    from siloml.functions import joins

    both = fitted(data[0].df, SvcSpec())[1]
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1)
    single = fitted(data[0].df, SvcSpec())[1]
    assert all(np.allclose(both[c], single[c]) for c in both)


def plain_boost(x, y, spec, edges):
    """Level-free second-order boosting on one silo; returns the training margins."""
    bins = np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1)
    margin = np.zeros(len(y))

    def grow(rows, depth):
        p = 1 / (1 + np.exp(-margin[rows]))
        g, h = p - y[rows], p * (1 - p)
        best = (1e-6, None)
        if depth < spec.max_depth:
            for f in range(x.shape[1]):
                for b in range(len(edges[f])):
                    left = bins[rows, f] <= b
                    hl, hr = h[left].sum(), h[~left].sum()
                    if hl < 1 or hr < 1:
                        continue
                    gain = g[left].sum() ** 2 / (hl + 1) + g[~left].sum() ** 2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, left)
        if best[1] is None:
            return [(rows, -spec.eta * g.sum() / (h.sum() + 1))]
        return grow(rows[best[1]], depth + 1) + grow(rows[~best[1]], depth + 1)

    for _ in range(spec.n_local_trees):
        for rows, step in [leaf for leaf in grow(np.arange(len(y)), 0)]:
            margin[rows] = margin[rows] + step
    return margin


@pytest.mark.parametrize("small", [B.SMALL, 200, 0])
def test_boosting_matches_plain_loops(data, small):
    """Silos grown in a task, level by level, and one of each."""
    prepared, keep = data
    spec = BoostSpec(n_local_trees=3, max_bins=16)
    edges = B.bin_edges(prepared.df, 3, 16)
    trees = B.boost(prepared.df, spec, 3, [0, 1], edges=edges, small=small)
    scored = {r["row_id"]: r["margin"] for r in B.predict_boost(prepared.df, trees, shared=False).collect()}
    start = 0
    for c, (x, y, tr) in keep.items():
        ids = start + np.flatnonzero(tr)
        want = plain_boost(x[tr], y[tr], spec, edges[c])
        assert np.allclose([scored[i] for i in ids], want)
        start += len(y)


def test_boosting_continues_from_the_ensemble(data):
    prepared, _ = data
    spec = BoostSpec(n_local_trees=1, max_bins=16)
    edges = B.bin_edges(prepared.df, 3, 16)
    one = Prepared(prepared.df.where("client_id = 0"), prepared.names, 1)
    both = B.boost(one.df, BoostSpec(n_local_trees=2, max_bins=16), 3, [0], edges=edges)
    first = B.boost(one.df, spec, 3, [0], edges=edges)
    second = B.boost(one.df, spec, 3, [0], first, 2, edges)
    together = first.unionByName(second)
    total = lambda t: one.df.sparkSession.createDataFrame(
        B.predict_boost(one.df, t).select("row_id", F.round("margin", 9).alias("m")).collect())
    assert total(both).exceptAll(total(together)).count() == 0


def test_boost_rounds_tree_count(data):
    shared, history, _ = R.run_rounds(data[0], BoostSpec(n_local_trees=2, max_bins=8, max_depth=2), RoundSpec(rounds=3))
    assert shared.count() == M.tree_count(2, 2, 3)
    assert [r["tree_id"] for r in shared.orderBy("tree_id").collect()] == list(range(M.tree_count(2, 2, 3)))
    auc = {r["round"]: r["value"] for r in history.where("metric = 'AUC'").collect()}
    assert auc[3] < auc[1]  # the value under this name is a log loss
    result = {(r["class"], r["metric"]): r["value"] for r in R.result_of(history, "boost").collect()}
    assert result["", "AUC"] == pytest.approx(np.mean(list(auc.values())))


def test_sound_bagging_uses_weights(data):
    spec = RoundSpec(rounds=1, merge="FedF1", trees_per_client=None, scale_first=True, weight_trees=True)
    shared, _, _ = R.run_rounds(data[0], BoostSpec(n_local_trees=2, max_bins=8, max_depth=2), spec)
    w = [r["weight"] for r in shared.collect()]
    assert len(w) == 4 and sum(w) == pytest.approx(4.0) and len(set(w)) == 2


def test_one_shot_and_warm_rounds(data):
    prepared, _ = data
    p1, h1, _ = R.run_rounds(prepared, LogisticSpec(C=1.0), RoundSpec(rounds=2))
    acc = {r["round"]: r["value"] for r in h1.where("metric = 'test_accuracy'").collect()}
    assert acc[1] == acc[2] and acc[1] > 0.75
    p2, h2, fits = R.run_rounds(prepared, SvcSpec(C=0.1), RoundSpec(rounds=2, one_shot=False, merge="FedF1", local_steps=2))
    assert p2.count() == 4 and fits.where("metric = 'train_accuracy'").count() == 4
    final = {(r["class"], r["metric"]): r["value"] for r in R.result_of(h2, "squared_hinge").collect()}
    assert 0.7 < final["", "test_accuracy"] <= 1.0 and final["", "loss"] > 0


def plain_network(vector, x, y, hidden, alpha):
    """Objective of one silo's network, written out."""
    d = x.shape[1]
    w1, w2, b1, b2 = vector[:d * hidden].reshape(d, hidden), vector[d * hidden:(d + 1) * hidden], vector[(d + 1) * hidden:-1], vector[-1]
    m = np.maximum(x @ w1 + b1, 0) @ w2 + b2
    return np.mean(np.logaddexp(0, m) - y * m) + alpha / (2 * len(y)) * ((w1 ** 2).sum() + (w2 ** 2).sum()), 1 / (1 + np.exp(-m))


def test_network_gradient_is_the_slope(data):
    _, keep = data
    x, y, tr = keep[0]
    spec = MlpSpec(hidden=5)
    net, v = N.Network(spec, 3), np.random.default_rng(3).normal(size=26)
    loss, grad = net.objective(v, net.statistic(v, x[tr], y[tr].astype(float), np.ones(tr.sum())))
    assert loss == pytest.approx(plain_network(v, x[tr], y[tr], 5, spec.alpha)[0])
    for i in range(26):
        e = np.eye(26)[i] * 1e-6
        rise = plain_network(v + e, x[tr], y[tr], 5, spec.alpha)[0] - plain_network(v - e, x[tr], y[tr], 5, spec.alpha)[0]
        assert grad[i] == pytest.approx(rise / 2e-6, abs=1e-6)


def test_mlp_lowers_its_loss_and_warm_starts(data):
    prepared, keep = data
    spec = MlpSpec(hidden=6, max_iter=30)
    fits = {r.client_id: r for r in N.fit_mlp(prepared.df, spec, 3).collect()}
    start = N.start_weights(3, 6, spec.seed)
    params = N.mlp_table(prepared.df.sparkSession.createDataFrame(list(fits.values())), 3, 6, 1)
    scored = {r.row_id: (r.prob, r.pred) for r in N.predict_mlp(prepared.df, params, 3, 6, 2).collect()}
    at = 0
    for c, (x, y, tr) in keep.items():
        first, _ = plain_network(start, x[tr], y[tr], 6, spec.alpha)
        last, _ = plain_network(np.array(fits[c].vector), x[tr], y[tr], 6, spec.alpha)
        assert fits[c].status == "OK" and last < 0.7 * first
        prob = plain_network(np.array(fits[c].vector), x, y, 6, spec.alpha)[1]
        assert np.allclose([scored[at + i][0] for i in range(len(y))], prob)
        assert all(scored[at + i][1] == int(prob[i] > 0.5) for i in range(len(y)))
        assert np.mean([scored[at + i][1] == y[i] for i in range(len(y))]) > max(np.mean(y), 1 - np.mean(y))
        at += len(y)
    _, history, _ = R.run_rounds(prepared, MlpSpec(hidden=6, max_iter=8), RoundSpec(rounds=2, one_shot=False, local_steps=2))
    acc = {r["round"]: r["value"] for r in history.where("metric = 'test_accuracy'").collect()}
    assert len(acc) == 2 and acc[2] > 0.5


def plain_tree(x, y, row_ids, client, tree, spec, edges):
    """One tree of one silo, node by node from the definitions."""
    bins = np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1)
    weight = FO.bootstrap(row_ids, spec.n_trees, spec.seed)[:, tree].astype(float)
    entropy = lambda w, p: -sum(q * np.log2(q) for q in (p / w, 1 - p / w) if q > 0)
    out = {}

    def grow(rows, heap, depth):
        w, pos = weight[rows].sum(), (weight[rows] * y[rows]).sum()
        best = (1e-9, None)
        if depth < spec.max_depth and len(rows) >= spec.min_samples_split and 0 < pos < w:
            for f in FO.subset(client, tree, heap, x.shape[1], FO.n_candidates(x.shape[1]), spec.seed):
                for b in range(len(edges[f])):
                    left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                    if min(len(left), len(right)) < spec.min_samples_leaf:
                        continue
                    s = [(weight[r].sum(), (weight[r] * y[r]).sum()) for r in (left, right)]
                    gain = round(entropy(w, pos) - sum(a * entropy(a, p) for a, p in s) / w, 10)
                    if gain > best[0]:
                        best = (gain, (int(f), edges[f][b], left, right))
        if best[1] is None:
            out[heap] = (-1, 0.0, pos / w if w else 0.0)
            return
        f, cut, left, right = best[1]
        out[heap] = (f, cut, 0.0)
        grow(left, 2 * heap, depth + 1)
        grow(right, 2 * heap + 1, depth + 1)

    grow(np.flatnonzero(weight > 0), 1, 0)
    return [out[h] for h in sorted(out)]


@pytest.mark.parametrize("small", [1 << 16, 60, 0])
def test_forest_matches_plain_loops(data, small):
    """Trees grown in one task, level by level, and by both."""
    prepared, keep = data
    spec = ForestSpec(n_trees=3, max_depth=4, max_bins=16)
    edges = {r.client_id: r.edges for r in B.edge_table(prepared.df, 3, 16).collect()}
    trees = FO.fit_forest(prepared.df, spec, 3, 2, small=small).collect()
    assert len(trees) == 6
    at = 0
    for c, (x, y, tr) in keep.items():
        for t in (t for t in trees if t.client_id == c):
            want = plain_tree(x[tr], y[tr].astype(float), at + np.flatnonzero(tr), c, t.tree_id, spec, edges[c])
            assert [n.id for n in t.nodes] == list(range(len(want)))
            assert [(n.feature, n.threshold) for n in t.nodes] == [(f, e) for f, e, _ in want]
            assert np.allclose([n.leaf for n in t.nodes], [p for _, _, p in want])
        at += len(y)


def test_forest_is_saved_and_merges_hyperparameters(data, tmp_path):
    from siloml.sources.models import read_model, write_model

    prepared, keep = data
    spec = ForestSpec(n_trees=9, max_depth=5)
    shared, history, _ = R.run_rounds(prepared, spec, RoundSpec(rounds=1))
    got = {r["pos"]: r["value"] for r in shared.collect()}
    assert got == {0: 9.0, 1: 5.0, 2: 5.0, 3: 1.0}
    majority = np.mean([max(np.mean(y), 1 - np.mean(y)) for _, y, _ in keep.values()])
    assert history.where("metric = 'test_accuracy'").first()["value"] > majority
    trees = FO.fit_forest(prepared.df, spec, 3, 2)
    write_model(trees, str(tmp_path / "forest"))
    again = read_model(prepared.df.sparkSession, str(tmp_path / "forest"), trees.schema)
    score = lambda t: sorted((r.row_id, r.prob) for r in FO.predict_forest(prepared.df, t, 2).collect())
    assert score(again) == score(trees)


@pytest.mark.parametrize("spec", [LogisticSpec(C=1.0), MlpSpec(hidden=4, max_iter=3), ForestSpec(n_trees=4, max_depth=3),
                                  BoostSpec(n_local_trees=1, max_bins=8)], ids=lambda s: s.family)
def test_a_broken_silo_is_skipped(data, spec):
    """A silo with one NaN fails for every family: it is not merged where failures are accepted, else no round is."""
    prepared, _ = data
    third = prepared.df.where("client_id = 0").withColumns({"client_id": F.lit(2), "row_id": F.col("row_id") + 10_000})
    nan = F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0))
    third = third.withColumn("features", F.when(F.col("row_id") == 10_000, nan).otherwise(F.col("features")))
    broken = Prepared(stage(prepared.df.unionByName(third)), prepared.names, 3)
    one = RoundSpec(rounds=1)
    shared, history, _ = R.run_rounds(broken, spec, one)
    alone, _, _ = R.run_rounds(prepared, spec, one)
    if spec.family == "boost":
        assert sorted(r.client_id for r in shared.collect()) == sorted(r.client_id for r in alone.collect()) == [0, 1]
    else:
        values = lambda p: {(r["layer"], r["pos"]): round(r["value"], 6) for r in p.collect()}
        assert values(shared) == values(alone)
    assert all(np.isfinite(r["value"]) for r in history.collect())
    _, _, facts = R.local_fit(R.trainer(broken, spec))
    assert {r.client_id: r.status for r in facts.collect()} == {0: "OK", 1: "OK", 2: "NON_FINITE"}
    with pytest.raises(ValueError, match="usable fits"):
        R.run_rounds(broken, spec, RoundSpec(rounds=1, accept_failures=False))


def test_central_baseline_and_sweep(data):
    prepared, _ = data
    columns = [F.get("features", F.lit(i)).alias(n) for i, n in enumerate("abc")]
    rows = prepared.df.select("row_id", "client_id", "split", "label", *columns)
    base = {(r["class"], r["metric"]): r["value"] for r in R.central_baseline(rows, LogisticSpec(C=1.0)).collect()}
    assert base["", "test_accuracy"] > 0.75 and base["", "accuracy"] == base["", "test_accuracy"]
    runs = R.sweep(lambda seed: prepared, [LogisticSpec()], RoundSpec(rounds=1), repeats=2)
    assert {r["run_id"] for r in runs.select("run_id").distinct().collect()} == {"logistic-1", "logistic-2"}
    assert runs.select("seed").distinct().count() == 2


def test_sweep_prepares_side_by_side(data, monkeypatch):
    """Repeats after the first wait for each other here; they keep their order, and an error comes through."""
    prepared, _ = data
    met, stacked = threading.Barrier(2, timeout=60), []

    def prepare(seed):
        if seed > 7:
            met.wait()
        return Prepared(prepared.df.withColumn("label", F.col("label") + 2 * seed), prepared.names, 2)

    monkeypatch.setattr(R, "stack_runs", lambda runs: stacked.extend(runs) or prepared)
    monkeypatch.setattr(R, "run_rounds", lambda *a: (None, prepared.df.selectExpr(
        "0 run", "1 round", "'' class", "'' metric", "0.0 value").limit(1), None))
    assert R.sweep(prepare, [LogisticSpec()], RoundSpec(rounds=1), repeats=3, seed=7).count() == 1
    assert [p.df.agg(F.min("label")).first()[0] for p in stacked] == [14, 16, 18]

    def broken(seed):
        if seed > 7:
            raise ValueError("broken")
        return prepared

    with pytest.raises(ValueError, match="broken"):
        R.sweep(broken, [LogisticSpec()], RoundSpec(rounds=1), repeats=3, seed=7)


@pytest.mark.parametrize("spec,rounds", [
    (SvcSpec(C=0.1), RoundSpec(rounds=2, one_shot=False, local_steps=1)), (ForestSpec(n_trees=3, max_depth=3), RoundSpec(rounds=2)),
    (BoostSpec(n_local_trees=2, max_bins=8, max_depth=2), RoundSpec(rounds=2, merge="FedF1"))], ids=lambda s: getattr(s, "family", ""))
def test_stacked_runs_are_independent(data, spec, rounds):
    """Two runs in the same jobs merge and score as each does alone."""
    prepared, _ = data
    other = Prepared(stage(prepared.df.withColumn("label", (F.get("features", F.lit(2)) > 0.3).cast("int"))), prepared.names, 2)
    values = lambda h: {(r["round"], r["class"], r["metric"]): round(r["value"], 6) for r in h.collect()}
    _, history, _ = R.run_rounds(stack_runs([prepared, other]), spec, rounds)
    for k, alone in enumerate((prepared, other)):
        if spec.family == "forest" and k:
            continue  # subsets and draws are hashed by the silo's id, which stacking changes
        assert values(history.where(F.col("run") == k)) == values(R.run_rounds(alone, spec, rounds)[1])


def test_zero_start(spark):
    z = P.init_zero(spark.createDataFrame([(0,)], "client_id int"), 3)
    assert P.rebuild_params(z).first()["vector"] == [0.0] * 4
