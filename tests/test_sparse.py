"""Levels without a limit: their table, the places of rows, and fits over them held against dense columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siloml.functions import joins
from siloml.functions.staging import stage
from siloml.operators import frame, hashrank
from siloml.spec import LogisticSpec, SvcSpec
from siloml.training import linear as L, sparse as S


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 2), "train" if i % 5 else "test", int(rng.random() < 0.3 + 0.4 * (i % 7 < 3)), float(rng.normal()),
             None if i % 50 == 0 else int(rng.integers(0, 12)) * 5, ["x", "y-1", "Ä", ""][i % 4]) for i in range(600)]
    return stage(spark.createDataFrame(
        rows, "row_id long, client_id int, split string, label int, a double, code int, `k.d` string"))


def test_level_table(table):
    rows = table.collect()
    want = [("code", str(v)) for v in sorted({r["code"] for r in rows} - {None})] + [("k.d", v) for v in sorted({r["k.d"] for r in rows})]
    got = sorted(frame.level_table(table, ["code", "k.d"]).collect(), key=lambda r: r["pos"])
    assert [(r["column"], r["level"]) for r in got] == want and [r["pos"] for r in got] == list(range(len(want)))
    assert sum(r["n"] for r in got) == 600 - 12 + 600
    assert frame.level_table(table.limit(0), ["code"]).count() == 0


def test_places_by_broadcast_and_by_shuffle(table, monkeypatch):
    levels = frame.level_table(table.where("code <> 5 OR code IS NULL"), ["code", "k.d"])
    place = {(r["column"], r["level"]): r["pos"] for r in levels.collect()}
    want = {r["row_id"]: (place.get(("code", str(r["code"])), -1), place[("k.d", r["k.d"])]) for r in table.collect()}
    assert any(p == -1 for p, _ in want.values())
    for size, hot in ((joins.BROADCAST_BYTES, joins.HOT_ROWS), (0, 100)):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", size)
        monkeypatch.setattr(joins, "HOT_ROWS", hot)
        got = frame.encode_levels(table, ["code", "k.d"], levels)
        assert got.columns == table.columns
        assert {r["row_id"]: (r["code"], r["k.d"]) for r in got.collect()} == want and got.count() == 600


@pytest.mark.parametrize("spec", [LogisticSpec(C=0.5), SvcSpec(C=0.5)])
def test_sparse_fit_is_the_dense_fit(table, spec):
    cats = ["code", "k.d"]
    rows = table.fillna({"code": 1000})
    levels = frame.level_table(rows, cats)
    n_levels = levels.count()
    numbers = stage(frame.split_xy(rows, ["a"]))
    sparse = stage(frame.with_levels(numbers, frame.encode_levels(rows.drop("client_id", "split", "label", "a"), cats, levels), cats))
    hot = frame.one_hot(rows, cats)
    dense = stage(frame.split_xy(hot, [c for c in hot.columns if c not in ("row_id", "client_id", "split", "label")]))
    want, _ = L.fit_linear(dense, spec, n_levels + 1)
    got, fits = S.fit_sparse(sparse, spec, 1, n_levels)
    key = lambda df: {(r["client_id"], r["layer"], r["pos"]): r["value"] for r in df.collect()}
    want_values, values = key(want), key(got)
    assert values.keys() == want_values.keys()
    assert fits.where("status <> 'OK'").count() == 0

    def total(vector_of):  # the objective of each silo: one-hot levels beside an intercept leave the squared hinge's optimum unique
        out = {}
        for r in dense.where("split = 'train'").collect():
            out.setdefault(r["client_id"], []).append((r["label"], r["features"]))
        return {c: (np.asarray([x for _, x in rs]) @ vector_of(c)[:-1] + vector_of(c)[-1]) for c, rs in out.items()}

    vector = lambda values: lambda c: np.asarray([v for (k, _, _), v in sorted(values.items()) if k == c])
    for c, m in total(vector(want_values)).items():
        assert np.allclose(total(vector(values))[c], m, atol=2e-3)
    scored = S.predict_sparse(sparse, got, 1, n_levels, 2)
    assert scored.count() == 600 and scored.where((F.col("margin") > 0) != (F.col("pred") == 1)).count() == 0


def test_absent_levels_and_failed_silos(spark):
    rows = spark.createDataFrame(
        [(i, c, "train" if c < 2 else "test", i % 2, [float("nan") if c == 1 and i == 21 else i / 10.0, -1.0]) for c in range(3) for i in range(20 * c, 20 * c + 20)],
        "row_id long, client_id int, split string, label int, features array<double>")
    fits = {r["client_id"]: r for r in S.fit_sparse(stage(rows), LogisticSpec(), 1, 4, strict=False)[1].collect()}
    assert [fits[c]["status"] for c in range(3)] == ["OK", "NON_FINITE", "NO_ROWS"]
    assert fits[0]["vector"][1:5] == [0.0] * 4


@pytest.mark.parametrize("bucket_rows", [1 << 18, 4096])
def test_buckets_are_cut_by_their_counts(spark, bucket_rows):
    n = 300_000
    df = stage(spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 1000 == 0).cast("int").alias("g")))
    ranked = stage(hashrank.hash_rank(df, ["g"], 5, hex_digits=1, bucket_rows=bucket_rows))
    assert ranked.columns == ["g", "row_id", "hash_rank"] or set(ranked.columns) == {"g", "row_id", "hash_rank"}
    rows = ranked.withColumn("h", F.md5(F.concat_ws("|", F.lit("5"), F.col("row_id").cast("string")))).toPandas()
    for _, part in rows.groupby("g"):
        part = part.sort_values(["h", "row_id"])
        assert (part["hash_rank"].to_numpy() == np.arange(len(part))).all()
    keyed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit("5"), F.col("row_id").cast("string"))))
    _, starts, _ = hashrank.hash_buckets(keyed, ["g"], 1, bucket_rows, "row_id")
    assert starts.agg(F.max("_cnt")).first()[0] <= bucket_rows

    cuts = hashrank.hash_cuts(df, ["g"], 5, lambda s: s.select("g", F.explode(F.array(
        F.lit(0), F.floor(F.col("n") / 3), F.floor(F.col("n") / 3), F.col("n") - 1, F.col("n"))).alias("pos")), 2, 5,
        hex_digits=1, bucket_rows=bucket_rows)
    for r in cuts.collect():
        part = rows[rows["g"] == r["g"]].sort_values("hash_rank")
        want = [(part["h"].iloc[p], part["row_id"].iloc[p]) for p in (0, len(part) // 3, len(part) // 3, len(part) - 1)]
        assert [(c["_h"], c["_key"]) for c in r["_cuts"]] == want


@pytest.mark.parametrize("spec", [LogisticSpec(C=0.5), SvcSpec(C=0.5)])
def test_alike_columns_and_many_levels_reach_the_optimum(spark, spec):
    """Columns of very unlike spread that nearly repeat each other, rare levels beside frequent ones, a silo of the few."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(4000):
        a, c = rng.normal(), int(i % 4 == 0)
        level = int(rng.integers(0, 3)) if i % 3 else 3 + int(rng.integers(0, 700))
        x = [a, a + 1e-3 * rng.normal(), 300.0 * a + rng.normal(), 1e-3 * rng.normal()]
        rows.append((i, c, "train", int(rng.random() < 1 / (1 + np.exp(-6 * a + level % 3))), [*x, float(level), 703.0 + int(rng.integers(0, 5))]))
    df = stage(spark.createDataFrame(rows, "row_id long, client_id int, split string, label int, features array<double>"))
    params, fits = S.fit_sparse(df, spec, 4, 708, strict=False)
    assert [r["status"] for r in fits.collect()] == ["OK", "OK"]
    vectors = {r["client_id"]: np.asarray(r["vector"]) for r in fits.collect()}
    for c, w in vectors.items():
        mine = [r for r in rows if r[1] == c]
        x = np.zeros((len(mine), 713))
        for k, r in enumerate(mine):
            x[k, :4], x[k, 4 + int(r[4][4])], x[k, 4 + int(r[4][5])], x[k, -1] = r[4][:4], 1.0, 1.0, 1.0
        y, m = np.asarray([r[3] for r in mine], float), x @ w
        if spec.family == "logistic":
            g = spec.C * x.T @ (1 / (1 + np.exp(-m)) - y)
            gap = np.where(w == 0, np.maximum(np.abs(g) - 1, 0), np.abs(g + np.sign(w)))
        else:
            s, weight = 2 * y - 1, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
            gap = np.abs(w - 2 * spec.C * x.T @ (weight * s * np.maximum(0, 1 - s * m)))
        assert gap.max() <= 1e-5 * max(1, spec.C * len(y))
