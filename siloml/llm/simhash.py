"""Near duplicates by SimHash fingerprints and a vantage-point tree over Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siloml.functions.staging import stage
from siloml.llm.common import join_measured, least_labels

SEED = 42  # Fixed value: of the shingles' XXH64
SAMPLE = 1 << 20  # most fingerprints that the tree's upper part is fitted on, 8 MB; a sixteenth of all at most
LEAF_ROWS = 2048  # fingerprints of a shard, by the sample
BLOCK = 512  # fingerprints that are compared with each other without a further split


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of a text's word shingles, in order; A-Z is lower-cased, a text of fewer words than ``width`` is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    grams = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), dtype="<u8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text's word shingles: a bit is set if it is set in over half of the shingles' hashes.

    A-Z is lower-cased; a text of fewer words than ``width`` is one shingle; no word (or null) gives 0.
    """
    hashes = shingle_hashes(text, width)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, the text's hash ``h`` and ``fp`` (a signed 64-bit integer) of every whole text."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.asarray([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found.view(np.int64))], names=["doc_id", "h", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, f"doc_id {key}, h bigint, fp bigint")


def choose_split(items: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point and a distance ``mu``: near items are within mu, far ones beyond.

    Near items beyond mu - radius are copied to the far side. Of a few vantage points, and all distances, the
    pair is taken that leaves the fewest comparisons; None if no split is worth its copies.
    """
    few = items if len(items) <= 2048 else items[rng.integers(0, len(items), 2048)]
    best, found = 0.8, None
    for v in items[rng.integers(0, len(items), 6)]:
        upto = np.cumsum(np.bincount(np.bitwise_count(few ^ v), minlength=65)) / len(few)
        far = 1 - np.concatenate((np.zeros(radius), upto[:-radius]))  # what lies beyond mu - radius
        cost = upto ** 2 + far ** 2
        mu = int(np.argmin(cost))
        if cost[mu] < best:
            best, found = float(cost[mu]), (int(v), mu)
    return found


def split(items: np.ndarray, vantage: int, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items on the near and on the far side."""
    d = np.bitwise_count(items ^ np.uint64(vantage))
    return np.flatnonzero(d <= mu), np.flatnonzero(d > mu - radius)


def fit_tree(sample: np.ndarray, radius: int, most: int) -> list[tuple]:
    """The upper tree: nodes (vantage, mu, near, far), or (leaf number,) for a shard."""
    rng, nodes, leaves, todo = np.random.default_rng(7), [None], 0, [(0, sample)]
    while todo:
        at, items = todo.pop()
        found = choose_split(items, radius, rng) if len(items) > most else None
        if found is None:
            nodes[at] = (leaves,)
            leaves += 1
            continue
        # The sample's copies are not counted: shards are cut by the items that are at home in them.
        d = np.bitwise_count(items ^ np.uint64(found[0]))
        nodes[at] = (*found, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), items[d <= found[1]]), (len(nodes) + 1, items[d > found[1]])]
        nodes += [None, None]
    return nodes


def route(nodes: list[tuple], items: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the places of the items that belong to them, copies at the borders included."""
    todo = [(0, np.arange(len(items)))]
    while todo:
        at, places = todo.pop()
        if not len(places):
            continue
        if len(nodes[at]) == 1:
            yield nodes[at][0], places
            continue
        vantage, mu, near, far = nodes[at]
        a, b = split(items[places], vantage, mu, radius)
        todo += [(near, places[a]), (far, places[b])]


def _block_links(items: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
    """(members, least member) of the connected groups in a block; each item is compared with those not yet reached."""
    if len(items) <= 4 * BLOCK:
        near = np.bitwise_count(items[:, None] ^ items[None, :]) <= radius
        np.fill_diagonal(near, False)
        left = items[near.any(axis=1)]
    else:
        left = items
    while len(left):
        group, left = [left[:1]], left[1:]
        frontier = left[:0] if not len(left) else group[0]
        while len(frontier):
            hit = np.zeros(len(left), bool)
            for f in frontier:
                hit |= np.bitwise_count(left ^ f) <= radius
            frontier, left = left[hit], left[~hit]
            group.append(frontier)
        members = np.concatenate(group)
        if len(members) > 1:
            yield members, int(members.min())


def shard_links(items: np.ndarray, radius: int) -> list[tuple[np.ndarray, int]]:
    """Links of a shard's distinct fingerprints: the tree goes on inside it until blocks are small."""
    rng, out, todo = np.random.default_rng(7), [], [items]
    while todo:
        now = todo.pop()
        found = choose_split(now, radius, rng) if len(now) > BLOCK else None
        if found is None:
            out += _block_links(now, radius)
            continue
        near, far = split(now, *found, radius)
        todo += [now[near], now[far]]
    return out


def links(fps: DataFrame, radius: int = 2, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` at ``radius`` or fewer differing bits.

    Exact: every pair within the radius meets in a shard, as each split copies the near items that could lie
    within the radius of a far one. A shard returns each linked item with the least of its group, so that a
    group of n gives n edges, not n * n. The upper tree is fitted on a bounded sample, so it is a small constant
    of the tasks; all fingerprints are routed through it.
    """
    n = fps.count()
    size = min(SAMPLE, n // 16)
    picked = fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(n, 1))) < size).limit(2 * SAMPLE).collect() if size else []
    sample = np.asarray([r.fp for r in picked], dtype=np.int64).view(np.uint64)
    nodes = fit_tree(sample, radius, max(16, int(leaf_rows * len(sample) / max(n, 1))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, places in route(nodes, items, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), leaf, np.int32)), pa.array(items[places].view(np.int64))],
                    names=["leaf", "fp"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        out = shard_links(np.sort(rows["fp"].to_numpy()).view(np.uint64), radius)
        a = np.concatenate([m for m, _ in out]) if out else np.zeros(0, np.uint64)
        b = np.concatenate([np.full(len(m), r, np.uint64) for m, r in out]) if out else a
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "leaf int, fp bigint")
    return dealt.groupBy("leaf").applyInPandas(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Every document's doc_id, text hash ``h``, fingerprint ``fp``, ``root`` (its component) and ``component_id``.

    Documents are linked if their fingerprints differ in ``radius`` or fewer bits; component_id is the smallest
    doc_id that links reach (null if all its ids are null). Equal fingerprints are one node, so copies cost a
    count. Texts without words have fingerprint 0 and are linked like others; rows that repeat stay rows of
    their own; an empty table gives no rows.
    """
    found = stage(fingerprints(docs, width))
    groups = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = stage(least_labels(stage(links(groups, radius))).withColumnRenamed("node", "fp"))
    linked = stage(join_measured(groups, labels, "fp", "inner"))
    smallest = stage(linked.groupBy("root").agg(F.min("least").alias("component")))
    members = stage(join_measured(linked, smallest, "root", "inner").select("fp", "root", "component"))
    nodes = stage(join_measured(groups, members, "fp").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(
            F.col("component")).alias("component_id")))
    return join_measured(found, nodes, "fp", "inner").select("doc_id", "h", "fp", "root", "component_id")
