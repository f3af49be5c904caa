"""Every stage of the pipeline against plain Python on the stage's own input."""

from collections import Counter

import brute
import pytest
from test_contracts import SF, awkward, rows_of, same  # noqa: F401

DOC = ("doc_id", "text", "lang", "source", "n_chars")


def base_kept(docs):
    return [d for d in docs if not brute.quality(d["text"])[-1]]


def lines_kept(docs):
    cleaned, out = brute.dedup_lines(docs), []
    for d in docs:
        text, n, gone = cleaned[d["doc_id"], d["text"]]
        if n > gone:
            out.append({**d, "text": text, "n_chars": len(text)})
    return out


def copies_kept(docs):
    import numpy as np
    import xxhash

    def fingerprint(text):
        words = brute.WORDS.findall(brute.lower(text or ""))
        grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(d["text"]) for d in docs]
    values = sorted(set(prints))
    a = np.asarray(values, np.uint64)
    pairs = [(values[i], values[j]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2)]
    roots, first = brute.components(values, pairs), {}
    for d, f in zip(docs, prints):
        key = (d["doc_id"] is None, d["doc_id"] or 0)
        if roots[f] not in first or key < first[roots[f]][0]:
            first[roots[f]] = (key, d)
    return [d for _, d in first.values()]


def mixed(docs):
    docs = list({(d["doc_id"], d["text"]): d for d in docs}.values())
    taken = {}
    for i, n, t in brute.mix([(d["doc_id"], d["source"], len(brute.WORDS.findall(d["text"] or ""))) for d in docs]):
        taken[i] = round(t / n) if n else 0
    return [d for d in docs for _ in range(taken[d["doc_id"]])]


@pytest.mark.parametrize("where", ["sample", "rows", "none"])
def test_stages(spark, awkward, where):  # noqa: F811
    import corpus_pipeline as pipeline
    from siloml.functions.staging import stage

    sf_dir = SF if where == "sample" else awkward[where]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "mixing sources", "packing"]
    for (_, f), plain in zip(pipeline.STAGES[:-1], (base_kept, lines_kept, copies_kept, mixed)):
        before = [r.asDict() for r in docs.collect()]
        docs = stage(f(spark, docs, sf_dir))
        assert docs.columns == names
        same([tuple(r) for r in docs.collect()], [tuple(d[c] for c in names) for d in plain(before)])
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    ids = dict(zip([i for i, _ in texts], brute.encode([t for _, t in texts])))
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert all(brute.crc_ids(ids[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32 for r in packed)
    used, times = Counter(), Counter(i for i, _ in texts)
    for r in packed:
        used[r.doc_id] += r.length
    assert used == {i: n * len(ids[i]) for i, n in times.items()}
    load = Counter()
    for r in packed:
        load[r.sequence_id] += r.length
    assert all(v <= 4096 for v in load.values())


def test_run(spark):
    """The whole run, and that it leaves nothing but its result behind."""
    import os

    import corpus_pipeline as pipeline
    from siloml.functions.staging import staging_dir

    folder = staging_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    packed = pipeline.run(spark, SF)
    assert packed.count() > 0
    assert len(set(os.listdir(folder)) - before) == 1


def test_near_dedup_keeps_one_of_each_group(spark):
    """Copies, copies with one word of many changed, repeated rows and texts without words: the least doc_id stays."""
    import corpus_pipeline as pipeline

    def text(i, n=400):
        return " ".join(f"w{(i * 7919 + k * 104729) % 99991}" for k in range(n))

    rows = [(i, text(i), "en", "a", 0) for i in range(20)]
    rows += [(100 + i, text(i), "en", "b", 0) for i in range(20)] + [(7, text(7), "en", "a", 0)]
    rows += [(200, None, "en", "a", 0), (201, " ", "en", "a", 0), (None, text(3), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept) == [*range(20), 200]
