"""Sizes and inputs that once were cut, or went through unnoticed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siloml.functions import joins
from siloml.functions.staging import SETTLE_ROWS, settle, stage
from siloml.operators import frame, knn as K
from siloml.plans import prepare as P, rounds as R
from siloml.sources import results
from siloml.spec import BoostSpec, GradientSpec, LogisticSpec, PrepareSpec, RoundSpec
from siloml.training import boost as B, linear as L


def stumps(spark, n):
    node = "named_struct('id', {0}, 'feature', {1}, 'threshold', {2}D, 'left', {3}, 'right', {4}, 'leaf', {5}, 'base_weight', 0D)"
    nodes = ", ".join((node.format(0, 0, "0.5", 1, 2, "0D"), node.format(1, -1, 0, -1, -1, "cast(id % 7 as double)"),
                       node.format(2, -1, 0, -1, -1, "cast(-(id % 5) as double)")))
    return spark.range(n).selectExpr("1 AS round", "0 AS client_id", "id AS tree_id", "1D AS weight", f"array({nodes}) AS nodes")


def test_every_tree_is_scored(spark, monkeypatch):
    n = 250_500
    rows = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [1.0])], "row_id long, client_id int, features array<double>")
    want = {0: float(sum(i % 7 for i in range(n))), 1: float(-sum(i % 5 for i in range(n)))}
    for nodes in (B.CHUNK_NODES, 300_000):
        monkeypatch.setattr(B, "CHUNK_NODES", nodes)
        got = B.predict_boost(rows, stumps(spark, n)).collect()
        assert {r["row_id"]: r["margin"] for r in got} == want


def test_kbest_counts_every_label(spark):
    rng = np.random.default_rng(0)
    label = np.arange(9000) % 3000
    x = rng.normal(size=(9000, 3)) + np.outer(label, [0.0, 1e-4, 2e-3])
    df = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(label, x))],
                               "row_id long, label int, a double, b double, c double")
    scores = []
    for i in range(3):
        groups = x[:, i].reshape(3, 3000).T
        between = 3 * ((groups.mean(axis=1) - x[:, i].mean()) ** 2).sum() / 2999
        scores.append(between / (((groups - groups.mean(axis=1, keepdims=True)) ** 2).sum() / 6000))
    order = [n for _, n in sorted(zip(scores, "abc"), reverse=True)]
    assert frame.select_kbest(df, 3, ["a", "b", "c"]) == order


def test_levels_are_bounded_by_column(spark):
    df = spark.range(30).select(F.col("id").alias("row_id"), (F.col("id") % 10).alias("few"), F.col("id").alias("many"))
    assert len(frame.category_levels(df, ["few", "many"])["many"]) == 30
    with pytest.raises(ValueError, match="many"):
        frame.category_levels(df, ["few", "many"], max_levels=20)


def test_settle_follows_the_rows_found(spark):
    small, large = settle(spark.range(10)), settle(spark.range(SETTLE_ROWS + 5))
    assert small.count() == 10 and large.count() == SETTLE_ROWS + 5
    assert "LocalTableScan" in small._jdf.queryExecution().executedPlan().toString() or "ExistingRDD" in \
        small._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in large._jdf.queryExecution().executedPlan().toString()


def silo_rows(spark, clients=(0, 1), bad=0.1):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a, b = rng.normal(size=2)
        rows.append((i, clients[i % len(clients)], "train" if i % 10 < 7 else "test" if i % 10 < 9 else "val", int(a + b + rng.normal() > 0),
                     bad if i == 3 else float(a), float(b)))
    return stage(spark.createDataFrame(rows, "row_id long, client_id long, split string, label int, a double, b double"))


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_nulls_are_refused(spark, bad):
    if bad is not None:
        df = silo_rows(spark, bad=bad)
    else:
        df = silo_rows(spark).withColumn("a", F.when(F.col("row_id") != 3, F.col("a")))
    with pytest.raises(ValueError, match="a"):
        P.transform_chain(df, PrepareSpec(encode=False, scale=False), 2)


def test_fit_refuses_nan_and_reports_missing_convergence(spark):
    rows = silo_rows(spark).withColumn("features", F.array("a", "b"))
    with pytest.raises(ValueError, match="not optimal"):
        L.fit_linear(rows, LogisticSpec(C=1.0, max_iter=1), 2)
    odd = rows.withColumn("features", F.when(F.col("row_id") == 3, F.array(F.lit(float("nan")), F.col("b"))).otherwise(F.col("features")))
    with pytest.raises(ValueError, match="null, NaN or infinite"):
        L.fit_linear(stage(odd), LogisticSpec(C=1.0), 2)


def test_too_few_silos_leave_no_model(spark):
    one = P.transform_chain(silo_rows(spark, (5,)), PrepareSpec(encode=False), 1)
    for one_shot in (True, False):
        with pytest.raises(ValueError, match="usable fits"):
            R.run_rounds(one, LogisticSpec(C=1.0), RoundSpec(rounds=2, one_shot=one_shot))


def test_round_without_a_merge_keeps_the_model(spark, monkeypatch):
    prepared = P.transform_chain(silo_rows(spark), PrepareSpec(encode=False), 2)
    alone, _, _ = R.run_rounds(prepared, GradientSpec(), RoundSpec(rounds=1, one_shot=False, local_steps=1))
    facts_of = R.facts_of

    def failing(p, metrics, round_no):
        return facts_of(p, metrics, round_no).withColumn("status", F.lit("FAILED" if round_no == 2 else "OK"))

    monkeypatch.setattr(R, "facts_of", failing)
    shared, history, _ = R.run_rounds(prepared, GradientSpec(), RoundSpec(rounds=2, one_shot=False, local_steps=1))
    assert {r["round"] for r in history.select("round").distinct().collect()} == {1}
    assert [tuple(r)[2:] for r in shared.orderBy("layer", "pos").collect()] == [tuple(r)[2:] for r in alone.orderBy("layer", "pos").collect()]


def test_empty_blocks_count(spark, tmp_path):
    (tmp_path / "a.txt").write_text("EXPERIMENT #1:\n\nClass 0:\n  precision: 0.5\n\nEXPERIMENT #1:\n\n")
    blocks = results.scan_experiments(spark, str(tmp_path))
    rows = results.average_results(results.parse_results(blocks), blocks.count()).collect()
    assert [(r["class"], r["metric"], r["value"]) for r in rows] == [("Class 0:", "precision", 0.25)]


def test_wide_silo_ids(spark):
    big = 2 ** 40
    df = silo_rows(spark, (big, big + 1))
    prepared = P.transform_chain(df, PrepareSpec(encode=False), 2)
    assert prepared.clients() == [big, big + 1]
    params, _ = L.fit_linear(prepared.df, LogisticSpec(C=1.0), 2)
    assert {r[0] for r in params.select("client_id").distinct().collect()} == {big, big + 1}
    trees = B.boost(prepared.df, BoostSpec(n_local_trees=2, max_bins=8), 2, prepared.clients())
    assert {r[0] for r in trees.select("client_id").distinct().collect()} == {big, big + 1}
    near = K.knn(prepared.df.select("client_id", "row_id", "features"), 2, 2, leaf_rows=20)
    assert near.count() == 800 and {r[0] for r in near.select("client_id").distinct().collect()} == {big, big + 1}
    _, history, _ = R.run_rounds(prepared, GradientSpec(), RoundSpec(rounds=2, one_shot=False, local_steps=1))
    assert history.select("round").distinct().count() == 2


def test_silo_groups_grow_the_same_trees(spark, monkeypatch):
    prepared = P.transform_chain(silo_rows(spark), PrepareSpec(encode=False), 2)
    spec = BoostSpec(n_local_trees=2, max_bins=8)
    # Sums of one silo are added in any order, so leaves agree to rounding.
    rows = lambda t: sorted((r["client_id"], r["tree_id"], [(n["id"], n["feature"], round(n["leaf"], 9)) for n in r["nodes"]])
                            for r in t.collect())
    both = rows(B.boost(prepared.df, spec, 2, [0, 1], small=0))
    monkeypatch.setattr(B, "GROUP_BYTES", 1)
    assert rows(B.boost(prepared.df, spec, 2, [0, 1], small=0)) == both
    assert rows(B.boost(prepared.df, spec, 2)) == both


def test_a_long_side_is_repeated_for_hot_keys_only(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "MANY_KEYS", 50)
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    rows = [(i, 7 if i < 300 else None if i < 310 else i % 97) for i in range(900)]
    df = stage(spark.createDataFrame(rows, "row_id long, client_id int"))
    side = stage(spark.createDataFrame([(c, c * 0.5) for c in range(90)], "client_id int, v double"))
    for how in ("inner", "left"):
        got = joins.attach(df, side, ["client_id"], 90, 16, how)
        assert got.columns == ["client_id", "row_id", "v"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, df.join(side, "client_id", how).collect()), key=repr)
    assert joins._salted(df, side, ["client_id"], 90, "row_id")[1].count() == 89 + joins.SALTS
