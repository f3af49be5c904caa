"""The newest operators' own interfaces: removal games, grid cells of codebooks, weighted samples."""

import itertools

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F


def test_potentials_give_the_sums_over_all_orders():
    from siloml.llm.filteraudit import potentials, shapley_sums

    rng = np.random.default_rng(2)
    for k in (1, 2, 4, 5):
        failed, n = rng.integers(0, 1 << k, 50), rng.integers(0, 9, 50)
        game = np.asarray([[int(n[(failed & s) != 0].sum()) for s in range(1 << k)]])
        want = [0] * k
        for order in itertools.permutations(range(k)):
            for i, f in enumerate(order):
                upto = sum(1 << x for x in order[:i])
                want[f] += int(game[0, upto | 1 << f] - game[0, upto])
        assert shapley_sums(game)[0].tolist() == want
        # Efficiency: all filters together share what all of them remove.
        assert sum(want) == potentials(game)[0, 0] + game[0, -1] * np.prod(range(1, k + 1))


def test_audit_of_other_filters(spark):
    from siloml.llm.filteraudit import audit_filters

    rows = spark.createDataFrame([("p", 3, 2, 1, 0), ("p", 1, 5, 0, 2), ("p", 0, 7, 7, 0), ("q", 0, 1, 1, 1)],
                                 "part string, failed int, n bigint, good bigint, toxic bigint")
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit_filters(rows, "XY").collect()}
    assert found["p", "XY", 1] == (7, 7, 0, 5, 1, 2, 12)
    assert found["p", "XY", 2] == (7, 0, 2, 0, 0, 0, 2)
    assert found["p", "YX", 1] == (12, 2, 0, 0, 1, 0, 2)
    assert found["p", "YX", 2] == (7, 5, 2, 5, 0, 2, 12)
    assert found["q", "XY", 2] == (1, 0, 0, 0, 0, 0, 0) and len(found) == 8
    with pytest.raises(ValueError):
        audit_filters(rows, "ABCDEFGH")


def test_copies_in_one_large_group(spark):
    """Only the least id of a group of copies stays, also when rows repeat or have no id."""
    from siloml.llm.filteraudit import failing_documents

    rows = [(i, "s", "same") for i in range(5, 2000)] + [(5, "t", "same"), (None, "s", "same"), (1, "s", "other")]
    found = failing_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    copies = found.where(F.col("failed").bitwiseAND(F.lit(16)) == 0).select("doc_id", "part", "n").collect()
    assert sorted(map(tuple, copies), key=repr) == [(1, "s", 1), (5, "s", 1), (5, "t", 1), (None, "s", 1)]
    assert found.agg(F.sum("n")).first()[0] == len(rows)


def brute_nearest(entries, x):
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("spread,cells", [(3, 64), (40, 16384), (100_000, 300), (1 << 25, 50)])
def test_grid_cells_keep_every_nearest_entry(spread, cells):
    """Ties (repeated entries, points half-way) go to the lesser index; a small memory starts anew without loss."""
    from siloml.llm.vectorcodes import PartCoder

    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (64, 4))
    entries[40] = entries[3]
    coder = PartCoder(entries, cells)
    for _ in range(3):
        x = rng.integers(-2 * spread, 2 * spread + 1, (3000, 4))
        x[:500] = (entries[rng.integers(0, 64, 500)] + entries[rng.integers(0, 64, 500)]) // 2
        x[500:700] = entries[rng.integers(0, 64, 200)]
        found, want = coder.nearest(x), brute_nearest(entries, x)
        assert np.array_equal(found[0], want[0]) and np.array_equal(found[1], want[1])
        assert len(coder.places) <= cells
    if spread == 40:
        assert coder.sizes[:len(coder.places)].mean() < 32  # most entries are dominated


def test_cells_with_one_hash_are_told_apart():
    from siloml.llm.vectorcodes import PartCoder

    rng = np.random.default_rng(0)
    coder = PartCoder(rng.integers(-50, 50, (16, 2)), 100)
    coder.mixers = np.zeros(2, np.uint64)  # every cell has the same hash
    x = rng.integers(-80, 80, (500, 2))
    want = brute_nearest(coder.entries, x)
    assert np.array_equal(coder.nearest(x)[0], want[0])


def test_codes_decode_to_their_entries(spark):
    from siloml.llm.vectorcodes import decode_vectors, encode_vectors

    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in e], i % 3) for i, e in enumerate(rng.normal(size=(300, 12)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    coded, books = encode_vectors(df, parts=4, entries=20, rounds=1)
    assert books.shape == (4, 20, 3)
    for r in decode_vectors(coded, books).collect():
        whole = np.floor(256 * np.asarray(rows[r.vec_id][1])).astype(int)
        assert r.vector == [int(v) for p, e in enumerate(r.codes) for v in books[p, e]]
        assert r.error == ((whole - np.asarray(r.vector)) ** 2).sum()


def test_weighted_samples_collide_by_generalised_jaccard():
    from siloml.llm.weightedprints import signatures

    rng = np.random.default_rng(6)
    for _ in range(6):
        a = {str(h).encode(): int(w) for h, w in zip(rng.integers(0, 1 << 63, 80), rng.integers(1, 30, 80))}
        b = {h: max(1, int(w * rng.choice([0.5, 1, 3]))) for h, w in a.items() if rng.random() < 0.8}
        b |= {str(h).encode(): 4 for h in rng.integers(0, 1 << 63, int(rng.integers(1, 60)))}
        keys = set(a) | set(b)
        want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        x, y = signatures([a, b], 4096)
        assert abs((x == y).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4096) + 1e-3


def test_signatures_do_not_depend_on_the_batch(monkeypatch):
    from siloml.llm import weightedprints as w

    texts = ["", " ".join(f"w{i % 900} v{i * i % 1501}" for i in range(5000)), "one", "two words", "one", "a b a c " * 9]
    together = w.fingerprints_of(texts)
    assert all(np.array_equal(w.fingerprints_of([t])[0], s) for t, s in zip(texts, together))
    monkeypatch.setattr(w, "TERMS", 7)
    assert np.array_equal(w.fingerprints_of(texts), together)
    assert not together[0].any() and together[1:].all()


def test_prints_of_rows_in_many_ranges(spark):
    """Neighbours are found across ranges, empty ranges and batches."""
    from siloml.llm import weightedprints as w

    rows = [(i * 3, f"text {i} " + "word " * (i % 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        found = {r.doc_id: r for r in w.compare_with_next(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(found) == len(rows)
    for at, (i, text) in enumerate(rows):
        after = rows[at - 1][1]
        own, other, edited = w.fingerprints_of([text, after, w.edited_text(text, after)])
        assert found[i].fingerprint == w.as_text(own) and found[i].edited_fingerprint == w.as_text(edited)
        assert found[i].near_next == (own == other).mean() and found[i].near_edited == (own == edited).mean()
    alone = w.fingerprint_documents(df).withColumnRenamed("fingerprint", "again")
    joined = w.compare_with_next(df).join(alone, "doc_id")
    assert joined.where("fingerprint != again").count() == 0
    assert joined.select(w.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("x"), "near_edited").where(
        "x != near_edited").count() == 0
