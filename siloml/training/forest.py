"""Random forests of all silos: histograms for large nodes, whole subtrees in a task for small ones.

Features are cut once into quantile bins; a row's bootstrap weight in a tree (Poisson, mean 1) and a node's feature
subset come from hashes, so a tree does not depend on where its rows lie. Nodes with more than ``SMALL`` training rows are
split level by level: one job adds up (rows, weight, positive weight) by node, feature of its subset and bin for all
trees of all silos. Smaller nodes are dealt to tasks with their rows, which grow them to the end (PLANET, Panda et
al. 2009). Both use the same splitting rule, so the bound changes no tree.

Nodes are numbered as in a heap (root 1, children 2i and 2i + 1). Forests are tree tables as in ``boost``; a leaf
holds the share of positives.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from siloml.functions.blocks import map_with_side
from siloml.functions.joins import attach
from siloml.functions.moments import FLUSH_VALUES, by_silo, matrix
from siloml.functions.staging import stage
from siloml.spec import CLIENT, FEATURES, LABEL, ROW_ID, SPLIT, TRAIN, ForestSpec, silo_type
from siloml.training.boost import TREE_SCHEMA, edge_table, tree_arrays, tree_leaf
from siloml.training.linear import weighted_rows

SMALL = 1 << 18  # training rows of a node that one task grows to the end, some ten MB
NODES_AT_ONCE = 64  # nodes of a level whose histograms such a task holds
MIN_GAIN = 1e-9  # bits
TREES_A_DIGEST = 4
LARGE, OPEN, DONE = "LARGE", "OPEN", "DONE"
NODES = "tree int, heap int, feature int, bin int, rows double, w double, pos double, state string"

# Numbers of 32 bits from which a Poisson draw of mean 1 is 1, 2, ... (its distribution function times 2^32).
POISSON = np.asarray([1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291,
                      4294609777, 4294923276, 4294962463, 4294966817], np.int64)


def bootstrap(row_ids, n_trees: int, seed: int) -> np.ndarray:
    """rows x trees draws: eight hex digits of md5(forest-seed|row|tree / 4) for each of four trees."""
    digests = -(-n_trees // TREES_A_DIGEST)
    data = b"".join(hashlib.md5(f"forest-{seed}|{r}|{k}".encode()).digest() for r in row_ids for k in range(digests))
    drawn = np.frombuffer(data, ">u4").reshape(len(row_ids), digests * TREES_A_DIGEST)[:, :n_trees]
    return np.searchsorted(POISSON, drawn.astype(np.int64), side="right").astype(np.uint8)


def subset(client, tree: int, heap: int, width: int, n: int, seed: int) -> np.ndarray:
    """The ``n`` features that a node may split on: those with the least md5(split-seed|silo|tree|node|feature)."""
    key = f"split-{seed}|{client}|{tree}|{heap}|"
    order = sorted(range(width), key=lambda f: hashlib.md5(f"{key}{f}".encode()).digest())
    return np.sort(order[:n])


def n_candidates(width: int) -> int:
    return max(1, int(np.sqrt(width)))


def histograms(bins, y, weight, sample_weight, slot, features, n_bins: int) -> np.ndarray:
    """nodes x features x bins x (rows, weight, positive weight) of rows in the nodes ``slot`` with subsets ``features``."""
    k, m = features.shape
    w = weight * sample_weight
    wy, base, rows = w * y, slot * n_bins, np.arange(len(bins))
    out = np.zeros((k, m, n_bins, 3))
    for j in range(m):
        flat = base + bins[rows, features[slot, j]]
        for i, v in enumerate((None, w, wy)):
            out[:, j, :, i] = np.bincount(flat, v, k * n_bins).reshape(k, n_bins)
    return out


def _bits(w, pos):
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.clip(pos / w, 0.0, 1.0)
        return -(np.where(p > 0, p * np.log2(p), 0.0) + np.where(p < 1, (1 - p) * np.log2(1 - p), 0.0))


def best_splits(h: np.ndarray, min_leaf: int):
    """(feature place, bin, gain, left sums, total sums) of each node: the first split with the greatest entropy gain."""
    left = h.cumsum(axis=2)[:, :, :-1]
    total = h[:, 0].sum(axis=1)
    right = total[:, None, None] - left
    lost = left[..., 1] * _bits(left[..., 1], left[..., 2]) + right[..., 1] * _bits(right[..., 1], right[..., 2])
    gain = _bits(total[:, 1], total[:, 2])[:, None, None] - lost / total[:, 1][:, None, None]
    # Sums of doubles differ by the order of addition: equal gains are made equal before the first is taken.
    gain = np.where((left[..., 0] >= min_leaf) & (right[..., 0] >= min_leaf), np.round(gain, 10), -np.inf)
    flat = gain.reshape(len(h), -1).argmax(axis=1)
    f, b = np.divmod(flat, gain.shape[2])
    at = np.arange(len(h))
    return f, b, gain[at, f, b], left[at, f, b], total


def may_split(sums: np.ndarray, depth: int, spec: ForestSpec) -> np.ndarray:
    rows, w, pos = sums.T
    return (depth < spec.max_depth) & (rows >= spec.min_samples_split) & (pos > 0) & (pos < w)


def depth_of(heap: int) -> int:
    return int(heap).bit_length() - 1


def grow(client, tree: int, heap: int, bins, y, weight, sample_weight, spec: ForestSpec, n_bins: int) -> list[tuple]:
    """The subtree below ``heap`` from its rows: (heap, feature, bin, rows, w, pos)."""
    width = bins.shape[1]
    n = n_candidates(width)
    w = weight * sample_weight
    at = np.full(len(bins), heap)
    out, sums = [], {heap: np.asarray([len(bins), w.sum(), (w * y).sum()])}
    for depth in range(depth_of(heap), spec.max_depth + 1):
        level = sorted(sums)
        able = may_split(np.stack([sums[h] for h in level]), depth, spec) if level else np.zeros(0, bool)
        out += [(h, -1, -1, *sums[h]) for h, ok in zip(level, able) if not ok]
        nodes = np.asarray([h for h, ok in zip(level, able) if ok])
        if not len(nodes):
            break
        slot = np.searchsorted(nodes, at)
        inside = (slot < len(nodes)) & (nodes[np.minimum(slot, len(nodes) - 1)] == at)
        bins, y, weight, sample_weight, at, slot = (v[inside] for v in (bins, y, weight, sample_weight, at, slot))
        features = np.stack([subset(client, tree, h, width, n, spec.seed) for h in nodes.tolist()])
        parts = []
        for s in range(0, len(nodes), NODES_AT_ONCE):
            r = np.flatnonzero((slot >= s) & (slot < s + NODES_AT_ONCE))
            h = histograms(bins[r], y[r], weight[r], sample_weight[r], slot[r] - s, features[s:s + NODES_AT_ONCE], n_bins)
            parts.append(best_splits(h, spec.min_samples_leaf))
        f, b, gain, left, total = (np.concatenate(v) for v in zip(*parts))
        split = gain > MIN_GAIN
        chosen = features[np.arange(len(nodes)), f]
        sums = {}
        for i, h in enumerate(nodes.tolist()):
            if split[i]:
                out.append((h, int(chosen[i]), int(b[i]), *total[i]))
                sums[2 * h], sums[2 * h + 1] = left[i], total[i] - left[i]
            else:
                out.append((h, -1, -1, *total[i]))
        goes_on = split[slot]
        right = bins[np.arange(len(bins)), chosen[slot]] > b[slot]
        at = 2 * at + right
        bins, y, weight, sample_weight, at = (v[goes_on] for v in (bins, y, weight, sample_weight, at))
    return out


def forest_blocks(df: DataFrame, edges: DataFrame, spec: ForestSpec, n_silos: int, width: int) -> DataFrame:
    """(client_id, block, bins, y, sample, draws): training rows in blocks, as bytes.

    Bins take a byte or two a feature, draws a byte a tree; y and the sample weight are doubles.
    """
    kind, key = np.dtype(np.uint8 if spec.max_bins <= 256 else np.uint16), silo_type(df)
    weighted = df.where(F.col(SPLIT) == TRAIN).select(ROW_ID, CLIENT, SPLIT, LABEL, FEATURES)
    if spec.balanced:
        weights = weighted_rows(df, True, n_silos).select(CLIENT, LABEL, "sample_weight").distinct()
        weighted = weighted.join(F.broadcast(weights), [CLIENT, LABEL])  # two rows a silo
    else:
        weighted = weighted.withColumn("sample_weight", F.lit(1.0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_pylist(), matrix(b.column(4))
            y, sample = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            out = []
            for client, r in by_silo(b.column(1).to_numpy(zero_copy_only=False)):
                draws = bootstrap([ids[i] for i in r], spec.n_trees, spec.seed)
                out.append((client, at, *(v.tobytes() for v in (x[r], y[r], sample[r], draws))))
                at += 1
            types = (b.column(1).type, pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)],
                                             names=[CLIENT, "block", "x", "y", "sample", "draws"])

    rows = weighted.select(ROW_ID, CLIENT, F.col(LABEL).cast("double"), "sample_weight", FEATURES).sortWithinPartitions(CLIENT)
    packed = rows.mapInArrow(pack, f"{CLIENT} {key}, block bigint, x binary, y binary, sample binary, draws binary")
    joined = attach(packed, edges.select(CLIENT, "edges"), [CLIENT], n_silos, 9 * width * spec.max_bins, salt_on="block")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                x = np.frombuffer(one.column(2)[0].as_buffer()).reshape(-1, width)
                found = np.stack([np.searchsorted(np.asarray(e, float), x[:, f], side="right")
                                  for f, e in enumerate(one.column(6)[0].as_py())], axis=1)
                yield pa.RecordBatch.from_arrays([*one.columns[:2], pa.array([found.astype(kind).tobytes()], pa.binary()), *one.columns[3:6]],
                                                 names=[CLIENT, "block", "bins", "y", "sample", "draws"])

    return joined.select(CLIENT, "block", "x", "y", "sample", "draws", "edges").mapInArrow(
        cut, f"{CLIENT} {key}, block bigint, bins binary, y binary, sample binary, draws binary")


def _unpacked(batch: pa.RecordBatch, i: int, width: int, n_trees: int, kind: np.dtype):
    """(y, sample weight, bins, weights) of a block."""
    bins, y, sample, draws = (batch.column(c)[i].as_buffer() for c in range(1, 5))
    return (np.frombuffer(y), np.frombuffer(sample), np.frombuffer(bins, kind).reshape(-1, width),
            np.frombuffer(draws, np.uint8).reshape(-1, n_trees))


def _with_nodes(blocks: DataFrame, nodes: DataFrame, spec: ForestSpec, n_silos: int) -> DataFrame:
    """(client_id, bins, y, sample, draws, nodes): the blocks and their silo's nodes."""
    row_bytes = 64 * spec.n_trees
    return attach(blocks, _per_silo(nodes), [CLIENT], n_silos, row_bytes, salt_on="block").select(
        CLIENT, "bins", "y", "sample", "draws", "nodes")


class _Known:
    """The nodes of the last silo met; a task's blocks come silo after silo."""

    def __init__(self, depth: int):
        self.depth, self.cell, self.trees = depth, None, {}

    def __call__(self, cell: pa.Array) -> dict:
        if self.cell is None or not cell.equals(self.cell):
            self.trees = _by_tree(cell[0].as_py(), self.depth)
            # A copy, so that the batch it stands in is not kept.
            self.cell = pa.concat_arrays([cell, cell[:0]]) if len(cell) else cell
        return self.trees


def _by_tree(nodes: list[dict], depth: int) -> dict[int, tuple[np.ndarray, np.ndarray, dict[int, str]]]:
    """{tree: (feature, bin by heap number, {heap: state} of the unfinished nodes)}."""
    out: dict = {}
    for n in nodes:
        if n["tree"] not in out:
            out[n["tree"]] = (np.full(2 << depth, -1), np.zeros(2 << depth, np.int64), {})
        f, b, open_nodes = out[n["tree"]]
        f[n["heap"]], b[n["heap"]] = n["feature"], n["bin"]
        if n["state"] != DONE:
            open_nodes[n["heap"]] = n["state"]
    return out


def _route(bins: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
    if f[1] < 0:
        return at
    while True:
        inner = f[at] >= 0
        if not inner.any():
            return at
        at = np.where(inner, 2 * at + (bins[rows, np.maximum(f[at], 0)] > b[at]), at)


def _per_silo(nodes: DataFrame) -> DataFrame:
    columns = [c.split(" ")[0] for c in NODES.split(", ")]
    return nodes.groupBy(CLIENT).agg(F.collect_list(F.struct(*columns)).alias("nodes"))


def _split_level(blocks: DataFrame, nodes: DataFrame, spec: ForestSpec, width: int, n_silos: int, n_bins: int, small: int) -> DataFrame:
    """The nodes after splitting the LARGE ones: these are DONE, their children LARGE, OPEN (for one task) or DONE."""
    kind, key = np.dtype(np.uint8 if n_bins <= 256 else np.uint16), silo_type(blocks)
    m = n_candidates(width)
    size = m * n_bins * 3

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}

        def flush():
            keys = list(totals)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], ctype), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array([totals[k].ravel() for k in keys], pa.list_(pa.float64()))],
                names=[CLIENT, "tree", "heap", "part"])
            totals.clear()
            return out

        ctype, known = None, _Known(spec.max_depth)
        looked_at = functools.lru_cache(1 << 16)(lambda client, tree, heap: subset(client, tree, heap, width, m, spec.seed))
        for batch in batches:
            ctype = batch.schema.field(0).type
            for i in range(batch.num_rows):
                client = batch.column(0)[i].as_py()
                y, sample, bins, weights = _unpacked(batch, i, width, spec.n_trees, kind)
                for tree, (f, b, unfinished) in known(batch.column(5).slice(i, 1)).items():
                    large = np.asarray(sorted(h for h, s in unfinished.items() if s == LARGE))
                    if not len(large):
                        continue
                    at = _route(bins, f, b)
                    slot = np.searchsorted(large, at)
                    use = (slot < len(large)) & (large[np.minimum(slot, len(large) - 1)] == at) & (weights[:, tree] > 0)
                    features = np.stack([looked_at(client, tree, h) for h in large.tolist()])
                    h = histograms(bins[use], y[use], weights[use, tree].astype(float), sample[use], slot[use], features, n_bins)
                    for node, part in zip(large.tolist(), h):
                        totals[client, tree, node] = totals[client, tree, node] + part if (client, tree, node) in totals else part
                    if len(totals) * size > FLUSH_VALUES:
                        yield flush()
        if totals:
            yield flush()

    sums = _with_nodes(blocks, nodes, spec, n_silos).mapInArrow(
        partial, f"{CLIENT} {key}, tree int, heap int, part array<double>")
    sums = sums.withColumn("part", array_to_vector("part")).groupBy(CLIENT, "tree", "heap").agg(
        vector_to_array(Summarizer.sum(F.col("part"))).alias("sums"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for client, tree, heap, flat in zip(pdf[CLIENT], pdf["tree"], pdf["heap"], pdf["sums"]):
                h = np.asarray(flat).reshape(1, m, n_bins, 3)
                depth = depth_of(heap)
                f, b, gain, left, total = (v[0] for v in best_splits(h, spec.min_samples_leaf))
                if not may_split(total[None], depth, spec)[0] or gain <= MIN_GAIN:
                    out.append((client, tree, heap, -1, -1, *total, DONE))
                    continue
                out.append((client, tree, heap, int(subset(client, tree, heap, width, m, spec.seed)[f]), int(b), *total, DONE))
                for child, s in ((2 * heap, left), (2 * heap + 1, total - left)):
                    state = DONE if not may_split(s[None], depth + 1, spec)[0] else OPEN if s[0] <= small else LARGE
                    out.append((client, tree, child, -1, -1, *s, state))
            yield pd.DataFrame(out, columns=[CLIENT, *[c.split(" ")[0] for c in NODES.split(", ")]])

    return nodes.where(F.col("state") != LARGE).unionByName(sums.mapInPandas(split, f"{CLIENT} {key}, {NODES}"))


def _grow_open(blocks: DataFrame, nodes: DataFrame, spec: ForestSpec, width: int, n_silos: int, n_bins: int) -> DataFrame:
    """The subtrees of the OPEN nodes: their rows are dealt out by (silo, tree, node), in pieces of bytes."""
    kind, key = np.dtype(np.uint8 if n_bins <= 256 else np.uint16), silo_type(blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(spec.max_depth)
        for batch in batches:
            for i in range(batch.num_rows):
                client, out = batch.column(0)[i].as_py(), []
                y, sample, bins, weights = _unpacked(batch, i, width, spec.n_trees, kind)
                for tree, (f, b, unfinished) in known(batch.column(5).slice(i, 1)).items():
                    if OPEN not in unfinished.values():
                        continue
                    at = np.where(weights[:, tree] > 0, _route(bins, f, b), 0)
                    order = np.argsort(at, kind="stable")
                    found, first = np.unique(at[order], return_index=True)
                    for h, r in zip(found.tolist(), np.split(order, first[1:])):
                        if unfinished.get(h) == OPEN:
                            out.append((client, tree, h, bins[r].tobytes(), y[r].tobytes(), sample[r].tobytes(), weights[r, tree].tobytes()))
                if out:
                    types = (batch.schema.field(0).type, pa.int32(), pa.int32(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                     names=[CLIENT, "tree", "heap", "bins", "y", "sample", "weights"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        client, tree, heap = pdf[CLIENT].iloc[0], int(pdf["tree"].iloc[0]), int(pdf["heap"].iloc[0])
        joined = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
        found = grow(int(client), tree, heap, joined("bins", kind).reshape(-1, width), joined("y", float),
                     joined("weights", np.uint8).astype(float), joined("sample", float), spec, n_bins)
        return pd.DataFrame([(client, tree, *n, DONE) for n in found], columns=[CLIENT, *[c.split(" ")[0] for c in NODES.split(", ")]])

    pieces = _with_nodes(blocks, nodes, spec, n_silos).mapInArrow(
        deal, f"{CLIENT} {key}, tree int, heap int, bins binary, y binary, sample binary, weights binary")
    return pieces.groupBy(CLIENT, "tree", "heap").applyInPandas(finish, f"{CLIENT} {key}, {NODES}")


def fit_forest(df: DataFrame, spec: ForestSpec, width: int, n_silos: int, round_no: int = 1, edges: DataFrame | None = None,
               small: int | None = None) -> DataFrame:
    """Forests of all silos (contract columns + features) as a tree table; a silo without training rows has no trees.

    A split looks at the square root of the features, chosen by hash, and keeps at least ``min_samples_leaf`` rows of the
    bootstrap sample on each side; nodes of fewer than ``min_samples_split`` are leaves. ``edges``: an edge table
    (client_id, edges); quantiles of each silo if None.
    """
    key = silo_type(df)
    small = SMALL if small is None else small
    edges = stage(edge_table(df, width, spec.max_bins)) if edges is None else edges
    n_bins = spec.max_bins
    blocks = stage(forest_blocks(df, edges, spec, n_silos, width))
    sizes = blocks.groupBy(CLIENT).agg((F.sum(F.length("y")) / 8).alias("rows"))
    trees = F.explode(F.sequence(F.lit(0), F.lit(spec.n_trees - 1)))
    nodes = stage(sizes.select(CLIENT, trees.alias("tree"), F.lit(1).alias("heap"), F.lit(-1).alias("feature"), F.lit(-1).alias("bin"),
                               "rows", F.lit(0.0).alias("w"), F.lit(0.0).alias("pos"),
                               F.when(F.col("rows") > small, LARGE).otherwise(OPEN).alias("state")))
    for _ in range(spec.max_depth + 1):
        if nodes.where(F.col("state") == LARGE).isEmpty():
            break
        nodes = stage(_split_level(blocks, nodes, spec, width, n_silos, n_bins, small))
    grown = _grow_open(blocks, nodes, spec, width, n_silos, n_bins)
    every = nodes.where(F.col("state") == DONE).unionByName(grown)
    return stage(tree_table(every, edges, key, round_no, spec.n_trees))


def tree_table(nodes: DataFrame, edges: DataFrame, key: str, round_no: int, n_trees: int) -> DataFrame:
    """Finished nodes as trees: ids in heap order, thresholds from the silo's edges, leaves hold the share of positives."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("heap")
        place = {h: i for i, h in enumerate(rows["heap"].tolist())}
        out = []
        for h, f, w, pos, threshold in zip(*(rows[c].tolist() for c in ("heap", "feature", "w", "pos", "threshold"))):
            share = pos / w if w else 0.0
            inner = f >= 0
            out.append({"id": place[h], "feature": f, "threshold": threshold if inner else 0.0, "left": place[2 * h] if inner else -1,
                        "right": place[2 * h + 1] if inner else -1, "leaf": 0.0 if inner else share, "base_weight": share})
        return pd.DataFrame({"round": [round_no], CLIENT: [pdf[CLIENT].iloc[0]], "tree_id": [int(pdf["tree"].iloc[0])],
                             "weight": [1.0 / n_trees], "nodes": [out]})

    # Edges are dealt out as rows (silo, feature, bin), and a split looks its threshold up.
    cuts = edges.select(CLIENT, F.posexplode("edges").alias("feature", "e")).select(
        CLIENT, "feature", F.posexplode("e").alias("bin", "threshold"))
    full = nodes.join(cuts, [CLIENT, "feature", "bin"], "left").select(CLIENT, "tree", "heap", "feature", "w", "pos", "threshold")
    return full.groupBy(CLIENT, "tree").applyInPandas(build, TREE_SCHEMA.replace(f"{CLIENT} int", f"{CLIENT} {key}"))


def forest_table(silos: DataFrame, spec: ForestSpec, round_no: int) -> DataFrame:
    """The four hyper-parameters of each silo as long parameter rows."""
    values = (spec.n_trees, spec.max_depth, spec.min_samples_split, spec.min_samples_leaf)
    return silos.select(F.lit(round_no).alias("round"), CLIENT, F.lit(0).alias("layer"),
                        F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("pos", "value"))


def predict_forest(df: DataFrame, trees: DataFrame, n_silos: int) -> DataFrame:
    """Add ``prob``, the mean share of positives over a silo's trees, and ``pred``. A silo without trees has 0."""
    forests = trees.groupBy(CLIENT).agg(F.collect_list(F.struct("tree_id", "weight", "nodes")).alias("trees"))
    forests = df.select(CLIENT).distinct().join(forests, CLIENT, "left")
    bytes_a_silo = 64 * (trees.groupBy(CLIENT).agg(F.sum(F.size("nodes")).alias("n")).agg(F.max("n")).first()[0] or 1)

    def read(trees):
        return [(t["weight"], tree_arrays(t["nodes"])) for t in sorted(trees or [], key=lambda t: t["tree_id"])]

    def score(trees, x):
        prob = np.zeros(len(x))
        for weight, arrays in trees:
            prob += weight * arrays[4][tree_leaf(x, arrays)]
        return prob, (prob > 0.5).astype(np.int32)

    return map_with_side(df, forests, "trees", score, "prob double, pred int", n_silos, bytes_a_silo, read)
