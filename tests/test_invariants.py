"""Exactness against brute force, and independence of partitioning and row order."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from siloml.functions import joins
from siloml.functions.hashing import seeded_hex
from siloml.operators import frame, hashrank, knn as K, metrics as E, resample, scale, silos


@pytest.fixture(scope="module")
def keyed(spark):
    # One group holds most rows.
    return spark.range(6000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 10 < 8, 0).otherwise((F.col("id") % 3 + 1)).cast("int").alias("client_id"),
        (F.col("id") % 5 == 0).cast("int").alias("label"))


def test_hash_rank_is_the_plain_rank(keyed):
    ranked = hashrank.hash_rank(keyed, ["client_id"], 9)
    plain = F.row_number().over(Window.partitionBy("client_id").orderBy(seeded_hex(9, "row_id"), "row_id")) - 1
    assert ranked.withColumn("plain", plain).where("plain <> hash_rank").count() == 0


def test_splits_do_not_depend_on_layout(keyed):
    a = silos.split_70_20_10(keyed.repartition(7), 3)
    b = silos.split_70_20_10(keyed.orderBy(F.desc("row_id")).coalesce(1), 3, n_silos=10 ** 7)  # salted joins
    cols = ["row_id", "client_id", "split"]
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0 and a.count() == 6000


def test_dirichlet_sizes_follow_the_bounds(keyed):
    df = keyed.drop("client_id")
    out = silos.dirichlet_silos(df, 4, 10.0, seed=5, min_silo_size=200)
    counts = silos.label_counts(df)
    bounds = silos.dirichlet_bounds(counts, 4, 10.0, 5, 200)
    got = {(r["label"], r["client_id"]): r["count"] for r in out.groupBy("label", "client_id").count().collect()}
    for label, ends in bounds.items():
        for silo, n in enumerate(np.diff([0, *ends])):
            assert got.get((label, silo), 0) == n
    assert out.count() == 6000
    with pytest.raises(ValueError, match="no draw"):
        silos.dirichlet_silos(df, 4, 10.0, seed=5, min_silo_size=3000)


def test_dirichlet_with_many_silos_uses_the_general_interval(keyed):
    out = silos.dirichlet_silos(keyed.drop("client_id"), 80, 10.0, seed=1, min_silo_size=0)
    assert out.agg(F.min("client_id"), F.max("client_id")).first()[:] == (0, 79)


def test_scaling(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 3, "train" if i % 4 else "test", 0, float(rng.normal(i % 3, 2)), 7.1) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, client_id int, split string, label int, a double, const double")
    out = scale.standard_scale(df, ["a", "const"]).where("split = 'train'").groupBy("client_id").agg(
        F.avg("a"), F.stddev_pop("a"), F.max(F.abs("const")))
    for r in out.collect():
        assert r[1] == pytest.approx(0, abs=1e-12) and r[2] == pytest.approx(1) and r[3] < 1e-9


def vectors(spark, x, clients, split="train"):
    rows = [(i, int(c), split, 0, [float(v) for v in xi]) for i, (c, xi) in enumerate(zip(clients, x))]
    return spark.createDataFrame(rows, "row_id long, client_id int, split string, label int, features array<double>")


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 100
    clients = np.arange(400) % 2
    df = vectors(spark, x, clients)
    cov = scale.covariance(df, 6, 2)
    for r in cov.collect():
        want = np.cov(x[clients == r["client_id"]].T)
        assert np.allclose(r["cov"], want[np.triu_indices(6)]) and r["n"] == 200
    loadings = scale.pca_loadings(cov, 3).collect()
    for c in (0, 1):
        v = np.array([r["loading"] for r in sorted(loadings, key=lambda r: r["component"]) if r["client_id"] == c])
        assert np.allclose(v @ v.T, np.eye(3))
        assert all(row[np.argmax(np.abs(row))] > 0 for row in v)
        top = np.linalg.eigvalsh(np.cov(x[clients == c].T))[::-1][:3]
        assert np.allclose([r["variance"] for r in sorted(loadings, key=lambda r: r["component"]) if r["client_id"] == c], top)
    out = {r["row_id"]: r["features"] for r in scale.pca(df, 3, 6, 2).collect()}
    v = np.array([r["loading"] for r in sorted(loadings, key=lambda r: r["component"]) if r["client_id"] == 0])
    assert np.allclose(out[0], v @ (x[0] - x[clients == 0].mean(axis=0)))
    with pytest.raises(ValueError):
        scale.pca(df, 7, 6, 2)


def brute_knn(x, clients, k):
    want = {}
    for i in range(len(x)):
        same = [j for j in range(len(x)) if clients[j] == clients[i] and j != i]
        d2 = [sum((x[i, t] - x[j, t]) ** 2 for t in range(x.shape[1])) for j in same]
        order = sorted(zip(d2, same))[:k]
        want[i] = [j for _, j in order]
    return want


@pytest.mark.parametrize("leaf_rows,chunk,hot", [(1000, 4096, 10 ** 6), (40, 4096, 10 ** 6), (40, 16, 50)])
def test_knn_is_exact(spark, monkeypatch, leaf_rows, chunk, hot):
    monkeypatch.setattr(K, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(420, 3)).round(1)  # coarse values: many equal distances
    x[:140] = x[0]  # a third of the rows are copies
    clients = np.where(np.arange(420) < 330, 0, np.arange(420) % 3)
    out = K.knn(vectors(spark, x, clients), 5, 3, leaf_rows=leaf_rows)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["nbr_rank"]):
        got.setdefault(r["row_id"], []).append(r["nbr_id"])
    assert got == brute_knn(x, clients, 5)


def test_knn_kernel_meets_few_points(monkeypatch):
    """A leaf's visitors are compared with the boxes inside their bounds, and get their exact lists."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    pairs, squared = [], K._squared
    monkeypatch.setattr(K, "_squared", lambda q, p: pairs.append(len(q) * len(p)) or squared(q, p))
    n = pa.array(range(3000), pa.int64())
    points = pa.table({"p_client_id": pa.array([7] * 3000), "point": n, "ids": pa.array([[i] for i in range(3000)]), "vec": x.tolist()})
    asked = pa.table({"v_client_id": pa.array([7] * 3000), "q": n, "q_vec": x.tolist(), "bound": pa.array([None] * 3000, pa.float64())})
    out = K._search(5)(asked, points)
    order = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :6]
    found = {r["q"]: [n["nbr_id"] for n in r["near"]] for r in out.to_pylist()}
    assert found == {i: order[i].tolist() for i in range(3000)}
    assert sum(pairs) < 0.25 * 3000 ** 2
    lacking = asked.slice(0, 1).set_column(2, "q_vec", pa.array([[0.0, None, 0.0]]))
    assert [n["d2"] for n in K._search(5)(lacking, points).to_pylist()[0]["near"]] == [None] * 6
    bounded = asked.set_column(3, "bound", pa.array(np.full(3000, 1e-3)))
    assert sum(len(r["near"]) for r in K._search(5)(bounded, points).to_pylist()) < 6 * 3000


def test_knn_with_few_rows(spark):
    x = np.array([[0.0], [1.0], [5.0], [9.0]])
    out = K.knn(vectors(spark, x, [0, 0, 0, 1]), 5, 2)
    rows = {}
    for r in out.collect():
        rows.setdefault(r["row_id"], {})[r["nbr_rank"]] = r["nbr_id"]
    assert rows == {0: {1: 1, 2: 2}, 1: {1: 0, 2: 2}, 2: {1: 1, 2: 0}}


def test_smote_points_lie_between_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    df = vectors(spark, x, np.zeros(200)).withColumn("label", (F.col("row_id") < 40).cast("int"))
    out = resample.smote(df, 11, k=3)
    made = [r["features"] for r in out.where("is_synthetic").collect()]
    assert len(made) == 120 and out.where("is_synthetic").select("row_id").distinct().count() == 120
    m = x[:40]
    near = brute_knn(m, np.zeros(40), 3)
    segments = [(m[i], m[j]) for i in near for j in near[i]]
    for p in made:
        assert any(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b) < 1e-9 for a, b in segments)
    assert len({tuple(p) for p in made}) > 100


def test_smote_among_copies(spark, monkeypatch):
    x = np.vstack([np.ones((30, 2)), np.random.default_rng(5).normal(size=(170, 2))])
    df = vectors(spark, x, np.zeros(200)).withColumn("label", (F.col("row_id") < 40).cast("int"))
    plain = sorted(resample.smote(df, 11).where("is_synthetic").collect())
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    assert sorted(resample.smote(df, 11).where("is_synthetic").collect()) == plain and len(plain) == 120


def test_undersample_is_a_subset(spark, keyed):
    df = silos.split_70_20_10(keyed, 3)
    out = resample.undersample(df, 5)
    assert out.exceptAll(df).count() == 0
    sizes = out.where("split = 'train'").groupBy("client_id", "label").count().groupBy("client_id").agg(
        F.min("count").alias("lo"), F.max("count").alias("hi"))
    assert sizes.where("lo <> hi").count() == 0
    assert out.where("split <> 'train'").count() == df.where("split <> 'train'").count()


def test_auc_with_ties_and_one_class(spark):
    rng = np.random.default_rng(4)
    s = rng.integers(0, 50, 3000) / 50.0
    s[:1000] = 0.5  # a third of the rows share one score
    y = rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(int(i % 2), int(y[i]), float(s[i])) for i in range(3000)] + [(9, 1, 0.3), (9, 1, 0.4)],
                               "client_id int, label int, prob double")
    got = {r["client_id"]: r["auc"] for r in E.auc(df).collect()}
    for c in (0, 1):
        pos, neg = s[(np.arange(3000) % 2 == c) & (y == 1)], s[(np.arange(3000) % 2 == c) & (y == 0)]
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert got[c] == pytest.approx(want, abs=1e-12)
    assert got[9] is None


def test_kbest(spark):
    rows = [(i, i % 2, float(i % 2) + (i % 7) / 10, float(i % 11), float(i % 2) * 0.1 + (i % 5)) for i in range(700)]
    df = spark.createDataFrame(rows, "row_id long, label int, strong double, noise double, weak double")
    assert frame.select_kbest(df, 1) == ["strong"]
    assert set(frame.select_kbest(df, 2)) == {"strong", "weak"} or frame.select_kbest(df, 2)[0] == "strong"
