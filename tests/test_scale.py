"""How often rows are read and in what form they are stored, on small silos."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siloml.functions.blocks import map_with_side
from siloml.functions.staging import stage
from siloml.plans.prepare import Prepared
from siloml.plans import rounds as R
from siloml.spec import BoostSpec, ForestSpec, LogisticSpec
from siloml.training import boost as B, forest as FO, iterate as I
from siloml.training.linear import Newton


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c, n in enumerate((300, 120)):
        x = rng.normal(size=(n, 3))
        y = (x[:, 0] > 0).astype(int)
        rows += [(len(rows) + i, c, ("train", "test", "val")[i % 3], int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, client_id int, split string, label int, features array<double>")
    return Prepared(stage(df.coalesce(2)), ("a", "b", "c"), 2)


def test_large_silos_are_read_in_blocks(prepared):
    """A level's job reads a row for some thousand training rows, and finds the sums of the rows themselves."""
    edges = B.bin_edges(prepared.df, 3, 16)
    rows = prepared.df.where("split = 'train'").withColumn("margin", F.lit(0.25))
    blocks = stage(B._binned(rows, edges, 16))
    assert blocks.count() <= 4
    sums = {r.client_id: np.reshape(r.sums, (2, 3, 16)) for r in B._level_sums(
        blocks, {0: None, 1: None}, {0: {0: 0}, 1: {0: 0}}, 3, 16).collect()}
    for c in (0, 1):
        y = np.asarray([r.label for r in rows.where(F.col("client_id") == c).collect()], float)
        p = 1 / (1 + np.exp(-0.25))
        assert np.allclose(sums[c][0].sum(axis=1), (p - y).sum())
        assert np.allclose(sums[c][1].sum(axis=1), len(y) * p * (1 - p))


def test_reports_score_the_rows_once(prepared, spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    score = R.BoostTrainer.score

    def once(self, params, shared):
        scored = score(self, params, shared)
        return scored.mapInArrow(counted, scored.schema)

    monkeypatch.setattr(R.BoostTrainer, "score", once)
    t = R.trainer(prepared, BoostSpec(n_local_trees=1, max_bins=16))
    trees, _, _ = R.local_fit(t)
    assert seen.value == 420
    R.local_evaluate(t, trees)
    assert seen.value == 840


def test_forest_rows_are_packed_by_one_step(prepared):
    """One block a silo and task, with bins of a byte, and nothing but bytes in it."""
    spec = ForestSpec(n_trees=5, max_bins=16)
    edges = stage(B.edge_table(prepared.df, 3, 16))
    blocks = FO.forest_blocks(prepared.df, edges, spec, 2, 3)
    assert blocks._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    got = blocks.collect()
    assert len(got) <= 4
    assert sum(len(r.y) for r in got) == 8 * 140 and sum(len(r.bins) for r in got) == 3 * 140
    assert sum(len(r.draws) for r in got) == 5 * 140


def test_a_side_value_is_read_once_for_blocks_in_a_row(prepared, spark):
    reads = spark.sparkContext.accumulator(0)

    def read(v):
        reads.add(1)
        return v + 1

    side = spark.createDataFrame([(0, 10), (1, 20)], "client_id int, v int")
    rows = prepared.df.unionByName(prepared.df).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = map_with_side(rows, side, "v", lambda v, x: [np.full(len(x), v)], "got int", 2, 16, read).select("client_id", "got").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.client_id, r.got) for r in out} == {(0, 11), (1, 21)} and len(out) == 840
    assert reads.value == 2


def test_small_silos_make_their_passes_in_one_job(prepared, monkeypatch):
    """The same fits as by a job a pass, and no pass over stored blocks."""
    rows = prepared.df.withColumn("sample_weight", F.lit(1.0))
    fit = lambda: {r.client_id: r for r in I.fit_silos(rows, Newton(LogisticSpec(C=0.5), 3), np.zeros(4), 50).collect()}
    with monkeypatch.context() as m:
        m.setattr(I, "SMALL_BYTES", 100 * 3 * 8)  # silo 0 by passes, silo 1 (40 training rows) in a task
        mixed = fit()
    monkeypatch.setattr(I, "_partial_sums", None)
    whole = fit()
    for c in (0, 1):
        assert whole[c].status == mixed[c].status == I.OK and whole[c].passes == mixed[c].passes
        assert np.allclose(whole[c].vector, mixed[c].vector)


def test_boosting_reads_arrays_once(prepared, monkeypatch):
    """Rounds fit and score packed rows: no array of features is read again, and the scores are those of the rows."""
    t = R.trainer(prepared, BoostSpec(n_local_trees=2, max_bins=16))
    monkeypatch.setattr(B, "packed_rows", lambda *a: pytest.fail("packed again"))
    trees = stage(t.fit(1, None, None))
    again = stage(t.fit(2, trees, None))
    assert again.count() == 4
    scored = t.score(trees, True)
    assert "features" not in scored._jdf.queryExecution().optimizedPlan().toString()
    key = lambda df: sorted((r["client_id"], r["split"], r["label"], r["pred"], r["prob"]) for r in df.collect())
    assert key(scored) == key(B.predict_boost(prepared.df, trees, True))
    monkeypatch.setattr(B, "CHUNK_NODES", 20)
    chunked = key(t.score(trees, True))
    assert [r[:4] for r in chunked] == [r[:4] for r in key(scored)]
    assert np.allclose([r[4] for r in chunked], [r[4] for r in key(scored)], rtol=0, atol=1e-12)


def test_small_trees_send_columns_where_they_send_rows(monkeypatch):
    rng = np.random.default_rng(2)
    tree = (np.asarray([1, 0, -1, 2, -1, -1, -1]), np.asarray([0.1, -0.2, 0, 0.3, 0, 0, 0]), np.asarray([1, 3, -1, 5, -1, -1, -1]),
            np.asarray([2, 4, -1, 6, -1, -1, -1]), np.asarray([0.0, 0, 1, 0, 2, 3, 4]))
    x = rng.normal(size=(500, 3))
    x[::50, 1] = np.nan
    by_column = B.tree_leaf(x, tree)
    monkeypatch.setattr(B, "SMALL_TREE", 0)
    assert (by_column == B.tree_leaf(x, tree)).all() and len(set(by_column)) == 4
