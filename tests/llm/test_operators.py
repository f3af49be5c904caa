"""The operators' own interfaces."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F


def test_token_file_answers_from_the_file():
    from siloml.llm.tokenfile import TokenFile, encode_file

    rng = np.random.default_rng(1)
    for n in (0, 1, 65536, 65537, 200_000):
        ids = (rng.zipf(1.3, size=n) % 49408).astype(np.uint16)
        lengths = np.asarray([n // 3, 0, n - n // 3])
        f = TokenFile(encode_file(ids, lengths, 16))
        assert np.array_equal(f.ids(), ids)
        if not n:
            assert f.count(5) == 0
            continue
        for i in {0, n // 2, n - 1}:
            assert f.access(i) == ids[i]
        value = int(ids[n // 2])
        places = np.flatnonzero(ids == value)
        assert f.count(value) == len(places) and f.count(value, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
        assert [f.select(value, j) for j in (0, len(places) - 1)] == [places[0], places[-1]]
        with pytest.raises(IndexError):
            f.select(value, len(places))
        if n <= 65537:
            continue
        few = TokenFile(encode_file(ids[:50], np.asarray([20, 30]), 16))
        assert np.array_equal(few.document(1), ids[20:50])
    assert f.count(1 << 20) == 0


def test_hamming_tree_is_exact():
    from siloml.llm.simhash import fit_tree, route, shard_links

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, size=4000, dtype=np.int64).view(np.uint64)
    near = [base]
    for flips in (1, 2, 3, 5):
        x = base[rng.integers(0, 20, 500)].copy()
        for _ in range(flips):
            x ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
        near.append(x)
    items = np.unique(np.concatenate(near))
    nodes = fit_tree(items[rng.integers(0, len(items), 1000)], 2, 60)
    assert sum(len(n) == 1 for n in nodes) > 4
    edges = [(int(m), r) for _, places in route(nodes, items, 2)
             for group, r in shard_links(np.sort(items[places]), 2) for m in group]
    pairs = [(int(items[i]), int(items[j])) for i in range(len(items))
             for j in np.flatnonzero(np.bitwise_count(items ^ items[i]) <= 2)]
    nodes = [int(i) for i in items]
    assert brute.components(nodes, edges) == brute.components(nodes, pairs)


def test_vectors_of_large_labels_are_cut(spark):
    """Cells, dense cells and visits of a label beyond a task's rows give the same links."""
    from siloml.llm.embeddings import near_vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8))
    for k in range(4):
        m = rng.integers(0, 700, 120)
        x[m] = x[k] + rng.normal(size=(len(m), 8)) * rng.choice([0.0, 0.02, 0.1])
    rows = [{"vec_id": i, "embedding": [float(v) for v in e], "label": int(i % 5 == 0)} for i, e in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted(map(tuple, near_vectors(df, 0.98, cell_rows=60).collect()))
    assert found == sorted(brute.vectors(rows))


def test_components_of_chains_and_stars(spark):
    from siloml.llm.common import least_labels

    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(200, 260)] + [(7, 7), (3, 2)]
    found = dict(map(tuple, least_labels(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = {n for e in edges for n in e}
    assert found == brute.components(nodes, edges)
    assert least_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_binomial_bound(spark):
    from siloml.llm.quality import most_allowed

    cases = [(n, r, p) for n in (0, 1, 50, 1000, 20_000, 300_000) for r in (0.0025, 0.05) for p in (0.05, 1e-5)]
    for n, risk, level in cases:
        got = spark.range(1).select(most_allowed(F.lit(n).cast("bigint"), risk, level).alias("k")).first().k
        assert got == min(brute.most_allowed(n, risk, level), int(np.ceil(n * risk))), (n, risk, level)


def test_cutoffs_hold_on_labelled_rows(spark):
    """Loose bounds prove cutoffs on few rows; each rejects no more good documents than the bound allows."""
    from siloml.llm import quality

    rows = [(i, "en" if i % 4 else None, 1 if i % 3 else 0) for i in range(1200)]
    texts = {1: "word%d of clean prose stands here and goes on " * 12, 0: "%d same same same words # " * 12}
    docs = spark.createDataFrame([(i, texts[q] % ((i,) * 12) if "%d" in texts[q] else texts[q], lang) for i, lang, q in rows],
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    measured = quality.measure_documents(docs)
    cuts = {r.stratum: r for r in quality.cutoffs(measured, labels, risk=0.05).collect()}
    assert set(cuts) == {None, "en"} and cuts["en"].symbols == 0.1
    none = {r.stratum: r for r in quality.cutoffs(measured, labels, risk=1e-6).collect()}
    assert all(none["en"][c] is None for c in quality.CUTOFFS)


def test_entropy_adds_spans_and_spares_public_forms():
    from siloml.llm.secrets import hot_windows, secret_spans

    key = "q7Rz1Xk9vB3mT5wY8pL2nD4s"
    spans = secret_spans(f"use {key} now")
    assert spans == [(4, "entropy", 4 + len(key))]
    for clean in ("123e4567-e89b-12d3-a456-426614174000", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=",
                  "a-long-hyphenated-name-of-a-thing", "2024-01-01/2024-12-31-000000", "Donaudampfschifffahrtsgesellschaft"):
        assert not [s for s in secret_spans(f"see {clean} here") if s[1] == "entropy"]
    # The counts that go along with the window agree with counting each window anew.
    for s in (key * 3, "aaaaaaaaaaaaaaaaaaaaaaaab" + key):
        plain = [i for i in range(len(s) - 19) if -sum(
            n / 20 * np.log2(n / 20) for n in np.unique(list(s[i:i + 20]), return_counts=True)[1]) >= 3.9 - 1e-12]
        assert list(hot_windows(s, 3.9 - 1e-12)) == plain


def test_sequences_of_packed_pieces(spark):
    from siloml.llm import packing

    docs = spark.createDataFrame([(i, f"alpha beta {i} " * (1 + 37 * i % 2000)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack(docs)
    rows = packing.sequences(packed).collect()
    total = sum(r.n_ids for r in rows)
    used = {r.sequence_id: r for r in rows}
    for r in packed.collect():
        own = used[r.sequence_id].ids[2 * r.offset:2 * (r.offset + r.length)]
        assert own == bytes(r.ids) and r.ids_crc32 == brute.crc_ids([int(i) for i in np.frombuffer(own, "<u2")])
    assert sorted(used) == list(range(len(rows)))
    assert all(len(r.ids) == 2 * r.n_ids <= 2 * 4096 for r in rows)
    assert total == sum(len(x) for x in brute.encode([r.text for r in docs.collect()]))
    assert len(rows) * 4096 <= 1.05 * total + 4096


def test_pieces_fill_their_slots():
    from siloml.llm.packing import SLACK, piece_lengths

    for length in [*range(1, 9000, 7), 4096, 8192]:
        cut = piece_lengths(length, 4096)
        assert sum(cut) == length and all(0 < m <= 4096 for m in cut)
        assert all((4096 // (4096 // m) - m) * SLACK <= 4096 // (4096 // m) for m in cut)


def test_shards_written_and_read(spark, tmp_path):
    from siloml.llm.sharding import write_shards

    docs = spark.createDataFrame([(i, "x" * (i * 37 % 400), "s") for i in range(300)], "doc_id long, text string, shard string")
    write_shards(docs.drop("shard"), 7, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 7


def test_encoder_equals_the_library():
    from siloml.llm.tokens import default_path, encoder

    enc = encoder(default_path())
    texts = ["", " ", "Hello, World! it's 12 o'clock", "a\nb\tc d", "naïve café́ Σας", "x" * 3000, "\x01", "a \x01 b",
             "<|endoftext|>x", "…—“quoted”", "日本語 テキスト", "don't!!! can't?", None]
    assert [list(map(int, x)) for x in enc.encode(texts)] == brute.encode(texts)


def test_encoder_learns_a_core_once(monkeypatch):
    """Upper case and closing marks do not send a word to the library again; odd texts have the library's ids."""
    from siloml.llm import tokens
    from siloml.llm.tokens import Encoder, default_path

    enc, asked = Encoder(default_path()), []
    enc._learn = lambda chunks, learn=enc._learn: (asked.extend(chunks), learn(chunks))
    texts = ["Word word, WORD. \"word\" word&&&", "Été été! word; x1, X1,", None, "H\u0331. h\u0331 \u0130x <\u0338 a\x0bb ½."]
    assert [list(map(int, x)) for x in enc.encode(texts)] == brute.encode(texts)
    assert len(asked) == len(set(asked)) and asked.count("word") == asked.count("été") == 1
    assert not {"Word", "WORD.", "WORD", "word,", "word&&&", "Été", "été!", "x1,", "X1,"} & set(asked)
    asked.clear()
    assert [list(map(int, x)) for x in enc.encode(["WORD!", "été&&&"])] == brute.encode(["WORD!", "été&&&"])
    assert not asked  # the core and the marks are known

    rng = np.random.default_rng(3)
    signs = [*"aAzZé É\u0338\u0331\u0301Iß\u1e9e\u0149\u0130\u0131\u212aΣς'\".,!?&<=\\ \n\t\x0b\r\x1c\x85\u00a0①½日\u1100\u1161\u0345\x00", "'s", "'ll"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(2000)]
    assert [list(map(int, x)) for x in enc.encode(texts)] == brute.encode(texts)
    monkeypatch.setattr(tokens, "CACHED", 100)  # little is kept, what is used often longest
    found = [x for at in range(0, 2000, 20) for x in enc.encode(texts[at:at + 20])]
    assert [list(map(int, x)) for x in found] == brute.encode(texts) and len(enc.kept) < 1000


def test_cover_trees_meet_in_blocks(monkeypatch):
    """Spread vectors with near copies: exact links, by far fewer distance computations than vectors."""
    from siloml.llm import embeddings

    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x = np.concatenate((x, x[:300] + rng.normal(size=(300, 16)) * 0.05, x[:50]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weights = rng.integers(1, 4, len(x))
    near = np.triu(x @ x.T >= 0.98, 1)
    near = near | near.T
    calls, chord = [], embeddings.chord
    monkeypatch.setattr(embeddings, "chord", lambda dots: calls.append(1) or chord(dots))
    for left, right in ((x, None), (x[:900], x[900:])):
        links = embeddings.Links(weights)
        tree = embeddings.CoverTree(left)
        if right is None:
            embeddings.traverse(tree, tree, left, left, 0.98, links, 0, True)
            wanted = near
        else:
            embeddings.traverse(tree, embeddings.CoverTree(right), left, right, 0.98, links, len(left), False)
            wanted = near.copy()
            wanted[:900, :900] = wanted[900:, 900:] = False
        assert np.array_equal(links.counts, wanted @ weights)
        edges = list(zip(*(c.tolist() for c in np.nonzero(wanted))))
        assert {i: int(r) for i, r in enumerate(links.root)} == {
            i: brute.components(range(len(x)), edges)[i] for i in range(len(x))}
    assert len(calls) < len(x)
