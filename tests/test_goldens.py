"""Hand-computed values."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siloml.operators import frame, merge as M, metrics as E, params as P, resample, silos
from siloml.plans.rounds import FACT_SCHEMA, METRIC_SCHEMA
from siloml.sources import results
from siloml.spec import PrepareSpec, validate_options

LOG = """
EXPERIMENT #1:

Class 0:
  precision: 0.84
  recall: 0.95
  f1-score: 0.89
  support: 467.0

Class 1:
  precision: 0.66
  recall: 1e-05
  f1-score: 0.47
  support: 133.0

accuracy: 0.81

Class test:
  accuracy: 0.81
"""
FLAT = """
EXPERIMENT #1:

0.0_precision: 0.8

1.0_recall: 0.4

accuracy: 0.7

macro avg_recall: 0.6

AUC: 0.43
"""


def params(spark, rows):
    return spark.createDataFrame(rows, P.SCHEMA)


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT_SCHEMA)


@pytest.fixture(scope="module")
def two(spark):
    p = params(spark, [(1, 0, 0, 0, 1.0), (1, 0, 0, 1, 2.0), (1, 1, 0, 0, 3.0), (1, 1, 0, 1, 6.0)])
    return p, lambda f: facts(spark, [(1, 0, 100, f, "OK"), (1, 1, 300, f, "OK")])


def values(df):
    return {(r["layer"], r["pos"]): r["value"] for r in df.collect()}


def test_split_sizes(spark):
    rows = [(c * 10_000 + i, c) for c, n in enumerate((1000, 1001, 304, 7, 1, 2)) for i in range(n)]
    df = silos.split_70_20_10(spark.createDataFrame(rows, "row_id long, client_id int"), seed=1)
    got = {}
    for r in silos.split_sizes(df).collect():
        got.setdefault(r["client_id"], {})[r["split"]] = r["n"]
    assert got[0] == {"train": 700, "test": 200, "val": 100}
    assert got[1] == {"train": 700, "test": 200, "val": 101}
    assert got[2] == {"train": 212, "test": 61, "val": 31}
    assert got[3] == {"train": 4, "test": 2, "val": 1}
    assert got[4] == {"val": 1}
    assert got[5] == {"train": 1, "val": 1}


def test_fedavg_and_fedf1(two):
    p, f = two
    assert values(M.fedavg(p, f(0.5))) == {(0, 0): 2.5, (0, 1): 5.0}
    assert values(M.fedf1(p, f(0.5))) == {(0, 0): 2.0, (0, 1): 4.0}
    with pytest.raises(PySparkException, match="all silo weights are zero"):
        M.fedf1(p, f(0.0)).collect()


def test_merge_of_equal_models_is_identity(spark):
    p = params(spark, [(1, c, 0, i, float(i + 1)) for c in range(4) for i in range(3)])
    f = facts(spark, [(1, c, 10 * (c + 1), 0.1 * (c + 1), "OK") for c in range(4)])
    for rule in (M.fedavg, M.fedf1):
        assert values(rule(p, f)) == pytest.approx({(0, i): i + 1.0 for i in range(3)})


def test_large_sides_take_the_salted_join(two):
    p, f = two
    assert values(M.fedavg(p, f(0.5), n_facts=10 ** 9)) == {(0, 0): 2.5, (0, 1): 5.0}


def test_failures_and_minimum(spark):
    f = facts(spark, [(1, 0, 5, 0.1, "OK"), (1, 1, 5, 0.1, "FAILED"), (2, 0, 5, 0.1, "OK"), (2, 1, 5, 0.1, "OK"),
                      (3, 0, 5, 0.1, "OK"), (3, 1, 5, 0.1, "OK"), (3, 2, 5, 0.1, "FAILED")])
    rounds = lambda df: sorted((r["round"], r["client_id"]) for r in df.collect())
    assert rounds(M.usable_facts(f)) == [(2, 0), (2, 1), (3, 0), (3, 1)]
    assert rounds(M.usable_facts(f, accept_failures=False)) == [(2, 0), (2, 1)]


def test_choose_merge_rejects_unknown():
    with pytest.raises(ValueError):
        M.choose_merge("logistic", "FedProx")


def test_hyperparams_are_cut_or_rounded(spark):
    p = params(spark, [(1, 0, 0, 0, 100.0), (1, 1, 0, 0, 101.0)])
    f = facts(spark, [(1, 0, 1, 0.5, "OK"), (1, 1, 3, 0.5, "OK")])
    assert values(M.choose_merge("forest", "FedAvg")(p, f)) == {(0, 0): 100}
    assert values(M.choose_merge("forest", "FedAvg")(p, f, truncate=False)) == {(0, 0): 101}


def test_metric_means(spark):
    m = spark.createDataFrame([(1, 0, "", "accuracy", 0.8), (1, 1, "", "accuracy", 0.6),
                               (1, 0, "", "AUC", 0.8), (1, 1, "", "AUC", 0.6)], METRIC_SCHEMA)
    f = facts(spark, [(1, 0, 100, 0.0, "OK"), (1, 1, 300, 0.0, "OK")])
    by = lambda df: {r["metric"]: r["value"] for r in df.collect()}
    assert by(M.weighted_metrics(m, f)) == pytest.approx({"accuracy": 0.65, "AUC": 0.65})
    assert by(M.mean_metrics(m)) == pytest.approx({"accuracy": 0.7, "AUC": 0.7})
    assert by(M.merge_eval(m, f, boosted=True)) == pytest.approx({"accuracy": 0.7, "AUC": 0.65, "loss": 0.0})


def test_tree_counts():
    assert M.tree_count(10, 5, 1) == 14
    assert M.tree_count(10, 5, 10) == 59


def test_bagging_order_and_weights(spark):
    from siloml.training.boost import TREE_SCHEMA

    node = [(0, -1, 0.0, -1, -1, 0.5, 2.0)]
    trees = spark.createDataFrame([(r, c, t, 1.0, node) for r in (1, 2) for c in (0, 1) for t in range(3)], TREE_SCHEMA)
    f = facts(spark, [(r, c, 10 * (c + 1), 0.25, "OK") for r in (1, 2) for c in (0, 1)])
    out = M.scale_base_weights(M.bag_trees(trees, f)).orderBy("tree_id").collect()
    assert [(r["tree_id"], r["round"], r["client_id"], r["weight"]) for r in out] == [
        (0, 1, 0, 1.0), (1, 1, 0, 1.0), (2, 1, 0, 1.0), (3, 1, 1, 20.0), (4, 2, 0, 10.0), (5, 2, 1, 20.0)]
    assert [r["nodes"][0]["base_weight"] for r in out] == [2.0, 2.0, 2.0, 40.0, 20.0, 40.0]
    sound = M.bag_trees(trees, f, "FedF1", None, scale_first=True, normalise=True)
    assert sound.count() == 12 and {r["weight"] for r in sound.collect()} == {1.0}


def test_losses(spark):
    df = spark.createDataFrame([(0, 1, 1, 0.9), (0, 0, 0, 0.2), (0, 1, 0, 0.4), (0, 0, 0, 0.1)],
                               "client_id int, label int, pred int, prob double")
    assert E.log_loss(df, probability="pred").first()["log_loss"] == pytest.approx(9.010913347, abs=1e-8)
    want = -(math.log(.9) + math.log(.8) + math.log(.4) + math.log(.9)) / 4
    assert E.log_loss(df).first()["log_loss"] == pytest.approx(want)
    assert E.eval_set_metric(df).first()["AUC"] == round(want, 4)
    assert E.auc(df).first()["auc"] == 1.0
    assert E.accuracy(df).first()["accuracy"] == 0.75


def test_report_with_absent_class(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (1, 0, 1), (1, 0, 0)], "client_id int, label int, pred int")
    rows = {(r["client_id"], r["class"], r["metric"]): r["value"] for r in
            E.classification_report(df, with_pooled=True).collect()}
    assert (0, "1", "precision") not in rows and rows[0, "0", "f1-score"] == 1.0
    assert rows[1, "1", "precision"] == 0.0 and rows[1, "1", "support"] == 0.0
    assert rows[1, "", "accuracy"] == 0.5 and rows[None, "", "accuracy"] == 0.75
    assert rows[None, "weighted avg", "recall"] == 0.75


def test_flatten_and_unflatten(spark):
    rep = spark.createDataFrame([(0, "0", "precision", .5), (0, "", "test_accuracy", .9)],
                                "client_id int, class string, metric string, value double")
    flat = E.flatten_metrics(rep)
    assert {r["name"] for r in flat.collect()} == {"0_precision", "test_accuracy"}
    back = {(r["path"], r["metric"], r["value"]) for r in E.unflatten_metrics(flat).collect()}
    assert back == {("0", "precision", .5), ("test", "accuracy", .9)}
    assert E.metrics_map(rep).first()["metrics"] == {"0_precision": .5, "test_accuracy": .9}


@pytest.fixture(scope="module")
def eighty_twenty(spark):
    rows = [(i, 0, "train", int(i < 20), [float(i), float(i * i % 17)]) for i in range(100)]
    rows += [(1000 + i, 0, "test", i % 2, [0.0, 1.0]) for i in range(10)]
    return spark.createDataFrame(rows, "row_id long, client_id int, split string, label int, features array<double>")


def test_rebalancing(eighty_twenty):
    w = {r["label"]: r["weight"] for r in silos.class_weights(eighty_twenty).collect()}
    assert w == {0: 0.625, 1: 2.5}
    sizes = lambda df: {(r["split"], r["label"]): r["count"] for r in df.groupBy("split", "label").count().collect()}
    rest = {("test", 0): 5, ("test", 1): 5}
    assert sizes(resample.undersample(eighty_twenty, 7)) == {("train", 0): 20, ("train", 1): 20, **rest}
    assert sizes(resample.smote(eighty_twenty, 7)) == {("train", 0): 80, ("train", 1): 80, **rest}


def test_smote_needs_two_rows(spark):
    df = spark.createDataFrame([(i, 0, "train", int(i == 0), [float(i)]) for i in range(5)],
                               "row_id long, client_id int, split string, label int, features array<double>")
    with pytest.raises(ValueError, match="too few"):
        resample.smote(df, 1)


def test_options():
    with pytest.raises(ValueError):
        validate_options(True, True, 0)
    with pytest.raises(ValueError):
        PrepareSpec(pca=1)
    validate_options(True, False, 2)


def test_credit_cleaning(spark):
    cols = ["ID", "SEX", "EDUCATION", "MARRIAGE", "PAY_0", "PAY_2", "default.payment.next.month"]
    df = spark.createDataFrame([(i, 1 + i % 2, i % 3, 10 if i % 2 else 2, i, -i, i % 2) for i in range(10)], cols)
    out = frame.clean_credit(df)
    assert out.columns == ["row_id", "label", "SEX", "EDUCATION", "MARRIAGE", "PAY_1", "PAY_2"]
    hot = frame.one_hot(out, frame.CREDIT_CATEGORICALS)
    assert hot.columns == ["row_id", "label", "PAY_1", "PAY_2", "SEX_1", "SEX_2", "EDUCATION_0", "EDUCATION_1",
                           "EDUCATION_2", "MARRIAGE_2", "MARRIAGE_10"]
    assert frame.feature_columns(hot, "SEX|EDUCATION|MARRIAGE") == ["PAY_1", "PAY_2"]
    assert hot.agg(F.sum("SEX_1"), F.sum("MARRIAGE_10")).first()[:] == (5.0, 5.0)
    with pytest.raises(ValueError):
        frame.select_columns(hot, ["PAY_5"])
    frame.require_no_nulls(hot, ["PAY_1"])
    with pytest.raises(ValueError, match="PAY_1"):
        frame.require_no_nulls(hot.withColumn("PAY_1", F.lit(None)), ["PAY_1"])


def test_params_round_trip(spark, tmp_path):
    from siloml.sources import models

    vec = spark.createDataFrame([(1, 0, [float(i) for i in range(13)])], "round int, client_id int, vector array<double>")
    flat = P.flatten_params(vec)
    assert P.rebuild_params(flat).first()["vector"] == [float(i) for i in range(13)]
    shaped = P.shape_params(flat, 2, 3, 1)
    sizes = {r["layer"]: r["count"] for r in shaped.groupBy("layer").count().collect()}
    assert sizes == {0: 6, 1: 3, 2: 3, 3: 1}
    assert P.rebuild_params(shaped).first()["vector"] == [float(i) for i in range(13)]
    path = str(tmp_path / "m")
    models.write_model(flat, path)
    back = models.read_model(spark, path, P.SCHEMA)
    assert sorted(back.collect()) == sorted(flat.select(*back.columns).collect())
    zero = P.init_zero(spark.createDataFrame([(3,), (3,), (4,)], "client_id int"), 2)
    assert zero.count() == 6 and zero.agg(F.max("value")).first()[0] == 0.0


def test_number_text(spark):
    nums = [0.84, 467.0, 1e-05, 1.5e-07, 0.0001, 0.00012345, -0.00025, 1e7, 123456789.125, 1.5e16, 0.0, -2.5, 12345678.0, 1e22]
    df = spark.createDataFrame([(float(n),) for n in nums], "x double")
    got = [r[0] for r in df.select(results.number_text(F.col("x"))).collect()]
    assert got == [str(float(n)) for n in nums]


def test_parse_class_log(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LOG + LOG)
    path = str(tmp_path)
    blocks = results.scan_experiments(spark, path)
    rows = lambda compat: {(r["class"], r["metric"]): r["value"] for r in results.average_results(
        results.parse_results(blocks, compat), blocks.count()).collect()}
    compat = rows(True)
    assert compat["Class 1:", "accuracy"] == 0.81 and compat["Class test:", "accuracy"] == 0.81
    assert compat["Class 1:", "recall"] == 1.0 and compat["Class 0:", "support"] == 467.0
    assert len(compat) == 10
    assert rows(False)["Class 1:", "recall"] == 1e-05
    assert results.count_results(spark, path).first()[1:] == (2, 2)
    lines = results.scan_lines(blocks)
    assert lines.where("line like '%EXPERIMENT%'").count() == 2
    summary = results.summary_report(results.average_results(results.parse_results(blocks), 2), {"round": 10}, 2).first()
    assert "precision: 0.84" in summary["report"] and summary["options"] == '{"round": 10}'


def test_missing_metric_counts_as_zero(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LOG + "\nEXPERIMENT #1:\n\nClass 0:\n  precision: 0.5\n")
    blocks = results.scan_experiments(spark, str(tmp_path))
    avg = {(r["class"], r["metric"]): r["value"] for r in results.average_results(results.parse_results(blocks), blocks.count()).collect()}
    assert avg["Class 0:", "precision"] == pytest.approx(0.67)
    assert avg["Class 0:", "recall"] == pytest.approx(0.475)


def test_parse_flat_log(spark, tmp_path):
    (tmp_path / "a.txt").write_text(FLAT + FLAT.replace("0.8", "0.6"))
    out = {(r["class"], r["metric"]): r["value"] for r in
           results.parse_results_flat(results.scan_experiments(spark, str(tmp_path))).collect()}
    assert out == pytest.approx({("Class 0", "precision"): 0.7, ("Class 1", "recall"): 0.4,
                                 ("Class test", "accuracy"): 0.7, ("Class macro avg", "recall"): 0.6})
