"""Boosted trees for all silos at once: all trees of small silos in one job, a job per tree level for large ones.

Silos that fit a task grow all their trees there. For the others, features are cut once into quantile bins, staged
together with the margin as bytes of blocks of rows; each finished tree moves the margin on, so a level's job only
routes rows through the tree being grown. Tasks add up gradient and Hessian
sums per (silo, node, feature, bin) over the blocks; Spark sums them and picks each node's best split in
parallel over nodes, and only the splits come to the driver. Large silos are trained in groups, so that neither
their bin edges nor their splits outgrow the driver. Both ways share the splitting rule.

Trees are rows (round, client_id, tree_id, weight, nodes) with nodes
array<struct<id, feature, threshold, left, right, leaf, base_weight>>; a leaf has feature -1.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siloml.functions.joins import attach
from siloml.functions.moments import FLUSH_VALUES, by_silo, matrix
from siloml.functions.staging import discard, stage, stage_at, staging_dir
from siloml.spec import CLIENT, FEATURES, LABEL, SPLIT, TRAIN, BoostSpec, silo_type

NODE = "struct<id:int,feature:int,threshold:double,left:int,right:int,leaf:double,base_weight:double>"
TREE_SCHEMA = f"round int, {CLIENT} int, tree_id bigint, weight double, nodes array<{NODE}>"
MIN_GAIN = 1e-6
GROUP_BYTES = 64 * 1024 * 1024  # bin edges of the silos that are trained together
SMALL = 1 << 18  # training rows of a silo whose trees one task grows, some ten MB
SMALL_TREE = 31  # nodes of a tree that sends a column of rows through each node, not each row from node to node
CHUNK_NODES = 1_000_000  # nodes of the trees that one pass over the rows scores, about 40 MB


def edge_table(df: DataFrame, width: int, max_bins: int) -> DataFrame:
    """(client_id, edges array<array<double>>): quantile cut points per silo and feature, one pass of sketches."""
    cuts = [i / max_bins for i in range(1, max_bins)]
    columns = [
        F.sort_array(F.array_distinct(F.percentile_approx(F.get(FEATURES, F.lit(i)), cuts, 10 * max_bins)))
        for i in range(width)
    ]
    return df.where(F.col(SPLIT) == TRAIN).groupBy(CLIENT).agg(F.array(*columns).alias("edges"))


def bin_edges(df: DataFrame, width: int, max_bins: int) -> dict[int, list[np.ndarray]]:
    """``edge_table`` as a dict, for the silos of one group."""
    return _edges(edge_table(df, width, max_bins))


def _edges(table: DataFrame) -> dict[int, list[np.ndarray]]:
    return {r[CLIENT]: [np.array(e, dtype=float) for e in r["edges"]] for r in table.collect()}


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b holds edges[b-1] <= x < edges[b]."""
    return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1)


def tree_arrays(nodes) -> tuple[np.ndarray, ...]:
    """(feature, threshold, left, right, leaf) arrays of a node list ordered by id."""
    ordered = sorted(nodes, key=lambda n: n["id"])
    pick = lambda f, t: np.array([n[f] for n in ordered], dtype=t)
    return pick("feature", int), pick("threshold", float), pick("left", int), pick("right", int), pick("leaf", float)


def _leaf_below(x: np.ndarray, tree: tuple[np.ndarray, ...], node: int):
    """``tree_leaf`` from ``node`` on, by whole columns: a number if the node is a leaf."""
    feature, threshold, left, right, _ = tree
    f = feature[node]
    if f < 0:
        return np.int64(node)
    return np.where(x[:, f] < threshold[node], _leaf_below(x, tree, left[node]), _leaf_below(x, tree, right[node]))


def tree_leaf(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """Node at which each row ends: go left while x < threshold."""
    feature, threshold, left, right, _ = tree
    if 1 < len(feature) <= SMALL_TREE:
        return _leaf_below(x, tree, 0)
    at = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        go_left = x[rows, np.maximum(f, 0)] < threshold[at]
        at = np.where(inner, np.where(go_left, left[at], right[at]), at)


def tree_score(x: np.ndarray, trees: list[tuple], weights: list[float]) -> np.ndarray:
    total = np.zeros(len(x))
    x = np.asfortranarray(x)  # small trees look at whole columns
    for t, w in zip(trees, weights):
        total += w * t[4][tree_leaf(x, t)]
    return total


def _gradients(y, margin):
    p = 1.0 / (1.0 + np.exp(-margin))
    return p - y, np.maximum(p * (1.0 - p), 1e-16)


def _node_sums(bins: np.ndarray, rows: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, n_nodes: int, n_bins: int):
    """Gradient and Hessian sums, each nodes x features x bins, of the ``rows`` of ``bins`` in the nodes ``slot``."""
    sums, base = np.zeros((2, n_nodes, bins.shape[1], n_bins)), slot * n_bins
    columns = np.ascontiguousarray(bins.T)
    if len(rows) < len(bins):
        columns = columns[:, rows]
    for f, column in enumerate(columns):
        flat = base + column
        for out, v in zip(sums, (g, h)):
            out[:, f] = np.bincount(flat, v, n_nodes * n_bins).reshape(n_nodes, n_bins)
    return sums


def _level_sums(blocks: DataFrame, partial: dict, slots: dict, width: int, bins: int) -> DataFrame:
    """(client_id, slot, sums): flat ([g, h], feature, bin) sums of the open nodes' rows, over blocks of binned rows.

    ``partial``: the tree being grown per silo, its thresholds in bins; ``slots``: node id -> slot of the nodes
    that are open on this level. A task keeps one table of sums for each open silo it meets.
    """
    key, kind = silo_type(blocks), _bin_type(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        ctype = None

        def flush():
            rows = [(c, s, part.ravel()) for c, table in totals.items() for s, part in enumerate(table)]
            totals.clear()
            types = (ctype, pa.int32(), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=[CLIENT, "slot", "part"])

        for batch in batches:
            ctype = batch.schema.field(0).type
            for client, packed, y, margin in zip(batch.column(0).to_pylist(), *batch.columns[2:]):
                open_slots = slots.get(client)
                if not open_slots:
                    continue
                y, margin = np.frombuffer(y.as_buffer()), np.frombuffer(margin.as_buffer())
                x = np.frombuffer(packed.as_buffer(), kind).reshape(len(y), width)
                g, h = _gradients(y, margin)
                table = np.full(max(open_slots) + 1, -1)
                table[list(open_slots)] = list(open_slots.values())
                at = tree_leaf(x, partial[client]) if partial[client] is not None else np.zeros(len(x), int)
                slot = np.where(at < len(table), table[np.minimum(at, len(table) - 1)], -1)
                rows = np.flatnonzero(slot >= 0)
                sums = np.stack(_node_sums(x, rows, slot[rows], g[rows], h[rows], len(open_slots), bins), axis=1)
                totals[client] = totals[client] + sums if client in totals else sums
                if sum(t.size for t in totals.values()) > FLUSH_VALUES:
                    yield flush()
        if totals:
            yield flush()

    parts = blocks.mapInArrow(run, f"{CLIENT} {key}, slot int, part array<double>")
    return parts.withColumn("part", array_to_vector("part")).groupBy(CLIENT, "slot").agg(
        vector_to_array(Summarizer.sum(F.col("part"))).alias("sums"))


def _best_splits(sums: DataFrame, width: int, bins: int, spec: BoostSpec) -> DataFrame:
    """(client_id, slot, g, h, feature, bin, gain, gl, hl): best split of each open node, nodes in parallel."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for client, slot, flat in zip(pdf[CLIENT], pdf["slot"], pdf["sums"]):
                g, h = np.asarray(flat).reshape(2, 1, width, bins)
                gt, ht = g[:, 0, :].sum(axis=1), h[:, 0, :].sum(axis=1)
                gl, hl = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
                best, gain = best_split(gl, hl, gt, ht, spec)
                f, b = divmod(int(best[0]), bins - 1)
                out.append((client, slot, float(gt[0]), float(ht[0]), f, b, float(gain[0]), float(gl[0, f, b]), float(hl[0, f, b])))
            yield pd.DataFrame(out, columns=[CLIENT, "slot", "g", "h", "feature", "bin", "gain", "gl", "hl"])

    return sums.mapInPandas(
        pick, f"{CLIENT} {silo_type(sums)}, slot int, g double, h double, feature int, bin int, gain double, gl double, hl double"
    )


def _leaf(node_id: int, g: float, h: float, spec: BoostSpec) -> dict:
    best = -g / (h + spec.reg_lambda)
    return {"id": node_id, "feature": -1, "threshold": 0.0, "left": -1, "right": -1,
            "leaf": spec.eta * best, "base_weight": best}


def _packed(ensemble: list, shared: bool) -> dict:
    packed: dict = {}
    for t in ensemble:
        trees, weights = packed.setdefault(None if shared else t[CLIENT], ([], []))
        trees.append(tree_arrays(t["nodes"]))
        weights.append(t["weight"])
    return packed


def _add_scores(df: DataFrame, packed: dict, shared: bool) -> DataFrame:
    """Move ``margin`` on by the trees of ``packed``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column(FEATURES))
            margin = batch.column("margin").to_numpy(zero_copy_only=False).copy()
            for client, rows in by_silo(batch.column(CLIENT).to_numpy(zero_copy_only=False)):
                trees, weights = packed.get(None if shared else client, ([], []))
                margin[rows] += tree_score(x[rows], trees, weights)
            rest = [c for c in batch.schema.names if c != "margin"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(margin)], [*rest, "margin"])

    rest = [f for f in df.schema.fields if f.name != "margin"]
    return df.mapInArrow(score, StructType([*rest, StructField("margin", DoubleType())]))


def _chunks(trees: DataFrame, shared: bool) -> Iterator[dict]:
    """All trees as ``_packed`` gives them, in as many parts as their nodes ask for."""
    nodes = trees.agg(F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()[0]
    chunks = max(1, -(-nodes // CHUNK_NODES))
    part = F.pmod(F.xxhash64("round", CLIENT, "tree_id"), F.lit(chunks))
    for k in range(chunks):
        some = trees.where(part == k) if chunks > 1 else trees
        yield _packed([r.asDict(recursive=True) for r in some.orderBy("round", CLIENT, "tree_id").collect()], shared)


def with_margin(df: DataFrame, trees: DataFrame | None, shared: bool, base_margin: float) -> DataFrame:
    """Add ``margin`` = base + sum of tree contributions.

    ``trees``: (round, client_id, tree_id, weight, nodes); shared by all silos, or each silo's own. All trees
    count: an ensemble beyond ``CHUNK_NODES`` nodes is scored in as many passes as it takes, each with its
    chunk of the trees.
    """
    df = df.withColumn("margin", F.lit(float(base_margin)))
    for k, packed in enumerate(_chunks(trees, shared) if trees is not None else ()):
        df = _add_scores(stage(df) if k else df, packed, shared)
    return df


def _with_classes(scored: DataFrame) -> DataFrame:
    return scored.withColumn("prob", 1.0 / (1.0 + F.exp(-F.col("margin")))).withColumn(
        "pred", (F.col("prob") > 0.5).cast("int")
    )


def predict_boost(df: DataFrame, trees: DataFrame, shared: bool = True, base_margin: float = 0.0) -> DataFrame:
    """Add ``margin``, ``prob`` and ``pred`` (prob > 0.5) from a tree table."""
    return _with_classes(with_margin(df, trees, shared, base_margin))


def packed_rows(df: DataFrame, base_margin: float = 0.0) -> DataFrame:
    """(client_id, split, block, x, y, margin): rows of a silo and split in blocks, as bytes of doubles, x column by column.

    Rows are read out of arrays once, whatever the trees and rounds; a null label is NaN. Without a column ``margin`` it
    is ``base_margin``, without a split all are training rows.
    """
    kind = silo_type(df)
    split = F.col(SPLIT) if SPLIT in df.columns else F.lit(TRAIN)
    start = F.col("margin") if "margin" in df.columns else F.lit(float(base_margin))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            if not b.num_rows:
                continue
            x, splits = matrix(b.column(3)), b.column(1).dictionary_encode()
            y, margin = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (2, 4))
            names = [*splits.dictionary.to_pylist(), None]
            code, out = splits.indices.fill_null(len(names) - 1).to_numpy(), []
            for client, rows in by_silo(b.column(0).to_numpy(zero_copy_only=False)):
                for k in np.unique(code[rows]).tolist():
                    r = rows[code[rows] == k]
                    out.append((client, names[k], at, x[r].T.tobytes(), y[r].tobytes(), margin[r].tobytes()))
                    at += 1
            types = (b.column(0).type, pa.string(), pa.int64(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=[CLIENT, SPLIT, "block", "x", "y", "margin"])

    rows = df.select(CLIENT, split.alias(SPLIT), LABEL, FEATURES, start.alias("margin")).sortWithinPartitions(CLIENT, SPLIT)
    return rows.mapInArrow(pack, f"{CLIENT} {kind}, {SPLIT} string, block bigint, x binary, y binary, margin binary")


def _unpacked(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, margin) of a block of ``packed_rows``."""
    x, y, margin = (np.frombuffer(b.column(c)[i].as_buffer()) for c in (3, 4, 5))
    return x.reshape(-1, len(y)).T, y, margin


def _packed_scores(blocks: DataFrame, packed: dict, shared: bool) -> DataFrame:
    """The blocks with their margins moved on by the trees of ``packed``."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, client in enumerate(b.column(0).to_pylist()):
                x, _, margin = _unpacked(b, i)
                moved = margin + tree_score(x, *packed.get(None if shared else client, ([], [])))
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns[:5], pa.array([moved.tobytes()], pa.binary())], names=b.schema.names)

    return blocks.mapInArrow(move, blocks.schema)


def _all_but_last(blocks: DataFrame, trees: DataFrame | None, shared: bool) -> tuple[DataFrame, dict]:
    """The blocks moved on by all chunks of the trees but the last, and that one."""
    last: dict = {}
    for k, packed in enumerate(_chunks(trees, shared) if trees is not None else ()):
        if k:
            blocks = stage(_packed_scores(blocks, last, shared))
        last = packed
    return blocks, last


def predict_packed(blocks: DataFrame, trees: DataFrame, shared: bool = True) -> DataFrame:
    """``predict_boost`` of packed rows: (client_id, split, label, margin, prob, pred)."""
    blocks, packed = _all_but_last(blocks, trees, shared)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, client in enumerate(b.column(0).to_pylist()):
                x, y, margin = _unpacked(b, i)
                moved = margin + tree_score(x, *packed.get(None if shared else client, ([], [])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(y), client), b.column(0).type), pa.array([b.column(1)[i].as_py()] * len(y), pa.string()),
                     pa.array(y, from_pandas=True).cast(pa.int32()), pa.array(moved)], names=[CLIENT, SPLIT, LABEL, "margin"])

    return _with_classes(blocks.mapInArrow(score, f"{CLIENT} {silo_type(blocks)}, {SPLIT} string, {LABEL} int, margin double"))


def _bin_type(bins: int) -> np.dtype:
    return np.dtype(np.uint8 if bins <= 256 else np.uint16 if bins <= 65_536 else np.int32)


def _binned(df: DataFrame, edges: dict[int, list[np.ndarray]], n_bins: int) -> DataFrame:
    """(client_id, block, bins, y, margin) of training rows with a margin."""
    return _cut(packed_rows(df), edges, n_bins, {}, True)


def _cut(blocks: DataFrame, edges: dict[int, list[np.ndarray]], n_bins: int, packed: dict, shared: bool) -> DataFrame:
    """(client_id, block, bins, y, margin) of packed rows: the bytes of bins (row by row) and of doubles.

    Margins are moved on by the trees of ``packed``.
    """
    kind = _bin_type(n_bins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, client in enumerate(b.column(0).to_pylist()):
                if client not in edges:
                    continue
                x, _, margin = _unpacked(b, i)
                bins = _bins(x, edges[client]).astype(kind)
                moved = margin + tree_score(x, *packed.get(None if shared else client, ([], [])))
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), one.column(2), pa.array([bins.tobytes()], pa.binary()), one.column(4), pa.array([moved.tobytes()], pa.binary())],
                    names=[CLIENT, "block", "bins", "y", "margin"])

    return blocks.mapInArrow(cut, f"{CLIENT} {silo_type(blocks)}, block bigint, bins binary, y binary, margin binary")


def _moved_margins(blocks: DataFrame, trees: dict, width: int, n_bins: int) -> DataFrame:
    """The blocks with each silo's finished tree (thresholds in bins) added to its rows' margins."""
    kind = _bin_type(n_bins)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, client in enumerate(batch.column(0).to_pylist()):
                one = batch.slice(i, 1)
                if client not in trees:
                    yield one
                    continue
                margin = np.frombuffer(one.column(4)[0].as_buffer())
                x = np.frombuffer(one.column(2)[0].as_buffer(), kind).reshape(len(margin), width)
                tree = trees[client]
                yield pa.RecordBatch.from_arrays(
                    [*one.columns[:4], pa.array([(margin + tree[4][tree_leaf(x, tree)]).tobytes()], pa.binary())], names=one.schema.names)

    return blocks.mapInArrow(move, blocks.schema)


def best_split(gl, hl, g, h, spec: BoostSpec):
    """(flat place, gain) of the best cut of each node from left sums nodes x features x cuts and the nodes' sums."""
    gr, hr, lam = g[:, None, None] - gl, h[:, None, None] - hl, spec.reg_lambda
    gain = gl ** 2 / (hl + lam) + gr ** 2 / (hr + lam) - (g ** 2 / (h + lam))[:, None, None]
    gain[(hl < spec.min_child_weight) | (hr < spec.min_child_weight)] = -np.inf
    flat = gain.reshape(len(g), -1)
    best = flat.argmax(axis=1)
    return best, flat[np.arange(len(g)), best]


def grow_silo(bins: np.ndarray, y: np.ndarray, margin: np.ndarray, spec: BoostSpec, n_bins: int) -> list[list[dict]]:
    """All trees of one silo from its rows; a node's ``bin`` is its cut. Each tree moves the margin on for the next."""
    width, trees = bins.shape[1], []
    for _ in range(spec.n_local_trees):
        g, h = _gradients(y, margin)
        nodes = [_leaf(0, g.sum(), h.sum(), spec)]
        at, open_nodes = np.zeros(len(y), np.int64), [0]
        for _ in range(spec.max_depth):
            if not open_nodes:
                break
            place = np.full(len(nodes), -1)
            place[open_nodes] = np.arange(len(open_nodes))
            slot = place[at]
            r = np.flatnonzero(slot >= 0)
            gs, hs = _node_sums(bins, r, slot[r], g[r], h[r], len(open_nodes), n_bins)
            gt, ht = gs[:, 0].sum(axis=1), hs[:, 0].sum(axis=1)
            gl, hl = gs.cumsum(axis=2)[..., :-1], hs.cumsum(axis=2)[..., :-1]
            best, gain = best_split(gl, hl, gt, ht, spec)
            fresh = []
            for s, n in enumerate(open_nodes):
                if gain[s] <= MIN_GAIN:
                    continue
                f, b = divmod(int(best[s]), n_bins - 1)
                left = len(nodes)
                nodes[n].update(feature=f, bin=b, leaf=0.0, left=left, right=left + 1)
                nodes += [_leaf(left, gl[s, f, b], hl[s, f, b], spec), _leaf(left + 1, gt[s] - gl[s, f, b], ht[s] - hl[s, f, b], spec)]
                mine = r[slot[r] == s]
                at[mine] = left + (bins[mine, f] > b)
                fresh += [left, left + 1]
            open_nodes = fresh
        trees.append(nodes)
        margin = margin + np.asarray([n["leaf"] for n in nodes])[at]
    return trees


def _grow_small(blocks: DataFrame, edges: DataFrame, spec: BoostSpec, width: int, n_silos: int, round_no: int, packed: dict,
                shared: bool) -> DataFrame:
    """Trees of silos with at most ``SMALL`` rows (packed training rows): a silo is a task's group."""
    key, n_bins = silo_type(blocks), spec.max_bins

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, client in enumerate(b.column(0).to_pylist()):
                x, _, margin = _unpacked(b, i)
                bins = _bins(x, [np.asarray(e, float) for e in b.column(6)[i].as_py()]).astype(_bin_type(n_bins))
                moved = margin + tree_score(x, *packed.get(None if shared else client, ([], [])))
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), pa.array([bins.tobytes()], pa.binary()), one.column(4), pa.array([moved.tobytes()], pa.binary())],
                    names=[CLIENT, "bins", "y", "margin"])

    joined = attach(blocks, edges.select(CLIENT, "edges"), [CLIENT], n_silos, 9 * width * spec.max_bins, salt_on="block")
    binned = joined.select(CLIENT, SPLIT, "block", "x", "y", "margin", "edges").mapInArrow(
        cut, f"{CLIENT} {key}, bins binary, y binary, margin binary")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        joined = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
        trees = grow_silo(joined("bins", _bin_type(n_bins)).reshape(-1, width), joined("y", float), joined("margin", float), spec, n_bins)
        out = [(pdf[CLIENT].iloc[0], k, n["id"], n["feature"], n.get("bin", -1), n["left"], n["right"], n["leaf"], n["base_weight"])
               for k, nodes in enumerate(trees) for n in nodes]
        return pd.DataFrame(out, columns=[CLIENT, "tree_id", "id", "feature", "bin", "left", "right", "leaf", "base_weight"])

    nodes = binned.groupBy(CLIENT).applyInPandas(
        grow, f"{CLIENT} {key}, tree_id bigint, id int, feature int, bin int, left int, right int, leaf double, base_weight double")
    cuts = edges.select(CLIENT, F.posexplode("edges").alias("feature", "e")).select(
        CLIENT, "feature", F.posexplode("e").alias("bin", "threshold"))
    node = F.struct("id", "feature", F.coalesce("threshold", F.lit(0.0)).alias("threshold"), "left", "right", "leaf", "base_weight")
    return nodes.join(cuts, [CLIENT, "feature", "bin"], "left").groupBy(CLIENT, "tree_id").agg(
        F.sort_array(F.collect_list(node)).alias("nodes")).select(
        F.lit(round_no).alias("round"), CLIENT, "tree_id", F.lit(1.0).alias("weight"), "nodes")


def boost(
    df: DataFrame,
    spec: BoostSpec,
    width: int,
    clients: list[int] | None = None,
    ensemble: DataFrame | None = None,
    round_no: int = 1,
    edges: dict[int, list[np.ndarray]] | DataFrame | None = None,
    small: int | None = None,
    shared: bool = True,
    packed: DataFrame | None = None,
) -> DataFrame:
    """Grow ``n_local_trees`` per silo on top of the ``ensemble`` (None: first round), shared by all or each silo's own.

    ``df``: staged contract columns + features. ``edges``: an edge table, or the dict of a few silos. Silos with at
    most ``small`` training rows (``SMALL`` if None) are grown each in a task, all trees in one job; larger ones level by
    level over all tasks, in groups of silos. ``packed``: the staged ``packed_rows`` of ``df``, for a caller that grows more
    than once. Returns only the new trees, of ``clients`` or all silos.
    """
    spark, kind = df.sparkSession, silo_type(df)
    small = SMALL if small is None else small
    own = f"{staging_dir(spark)}/packed-{uuid.uuid4().hex}" if packed is None else None
    if edges is None:
        edges = stage(edge_table(df, width, spec.max_bins))
    elif isinstance(edges, dict):
        edges = spark.createDataFrame([(int(c), [[float(v) for v in e] for e in es]) for c, es in edges.items()],
                                      f"{CLIENT} {kind}, edges array<array<double>>")
    if own:
        packed = stage_at(packed_rows(df.where(F.col(SPLIT) == TRAIN), spec.base_margin), own)
    train = packed.where(F.col(SPLIT) == TRAIN)
    sizes = stage(train.groupBy(CLIENT).agg((F.sum(F.length("y")) / 8).cast("bigint").alias("n")))
    if clients is not None:
        sizes = sizes.join(spark.createDataFrame([(int(c),) for c in clients], f"{CLIENT} {kind}"), CLIENT, "left_semi")
    seen = sizes.agg(F.count("*").alias("n"), F.count_if(F.col("n") > small).alias("large")).first()
    rows, last = _all_but_last(train, ensemble, shared)
    grown = None
    if seen.n > seen.large:
        few = rows if not seen.large and clients is None else rows.join(sizes.where(F.col("n") <= small).select(CLIENT), CLIENT, "left_semi")
        grown = stage(_grow_small(few, edges, spec, width, seen.n, round_no, last, shared))
    if seen.large:
        large = [r[0] for r in sizes.where(F.col("n") > small).select(CLIENT).orderBy(CLIENT).collect()]  # rows / SMALL at most
        trees = _grow_large(rows, spec, width, large, edges, round_no, kind, last, shared)
        grown = trees if grown is None else grown.unionByName(trees)
    if own:
        discard(spark, own)
    return grown if grown is not None else spark.createDataFrame([], TREE_SCHEMA.replace(f"{CLIENT} int", f"{CLIENT} {kind}"))


def _grow_large(rows: DataFrame, spec: BoostSpec, width: int, clients: list[int], edges: DataFrame, round_no: int, kind: str,
                packed: dict, shared: bool) -> DataFrame:
    """Trees of silos too large for a task, in groups whose bin edges and splits fit the driver."""
    spark = rows.sparkSession
    per_group = max(1, GROUP_BYTES // (8 * width * spec.max_bins))
    grown: DataFrame | None = None
    for at in range(0, len(clients), per_group):
        group = clients[at:at + per_group]
        ids = F.broadcast(spark.createDataFrame([(c,) for c in group], f"{CLIENT} {kind}"))
        known = _edges(edges.join(ids, CLIENT, "left_semi"))
        trees = _grow_group(rows.join(ids, CLIENT, "left_semi"), spec, width, [c for c in group if c in known], known, round_no, kind, packed, shared)
        grown = trees if grown is None else stage(grown.unionByName(trees))
    return grown


def _grow_group(df: DataFrame, spec: BoostSpec, width: int, clients: list[int], edges: dict, round_no: int, kind: str,
                packed: dict, shared: bool) -> DataFrame:
    bins = max((len(edges[c][i]) for c in clients for i in range(width)), default=0) + 1
    if not clients:
        return df.sparkSession.createDataFrame([], TREE_SCHEMA.replace(f"{CLIENT} int", f"{CLIENT} {kind}"))
    spark, base = df.sparkSession, f"{staging_dir(df.sparkSession)}/boost-{uuid.uuid4().hex}"
    rows, grown = stage_at(_cut(df, edges, bins, packed, shared), f"{base}/0"), []
    for tree_no in range(spec.n_local_trees):
        nodes: dict[int, dict[int, dict]] = {c: {} for c in clients}
        cuts: dict[int, dict[int, int]] = {c: {} for c in clients}  # split bin of the inner nodes
        open_nodes = {c: [0] for c in clients}

        def in_bins(c):
            return tree_arrays([{**n, "threshold": cuts[c].get(n["id"], 0) + 0.5} for n in nodes[c].values()])

        for _ in range(spec.max_depth):
            live = [c for c in clients if open_nodes[c]]
            if not live:
                break
            slots = {c: {n: s for s, n in enumerate(open_nodes[c])} for c in live}
            partial = {c: in_bins(c) if nodes[c] else None for c in live}
            sums = _level_sums(rows, partial, slots, width, bins)
            fresh: dict[int, list] = {c: [] for c in clients}
            for s in sorted(_best_splits(sums, width, bins, spec).collect(), key=lambda s: s["slot"]):
                c = s[CLIENT]
                node_id = open_nodes[c][s["slot"]]
                node = nodes[c].setdefault(node_id, _leaf(node_id, s["g"], s["h"], spec))
                if s["gain"] <= MIN_GAIN:
                    continue
                # The split's own sums give both children's leaves, so the deepest level needs no job.
                left = len(nodes[c])
                cuts[c][node_id] = s["bin"]
                node.update(feature=s["feature"], threshold=float(edges[c][s["feature"]][s["bin"]]), leaf=0.0,
                            left=left, right=left + 1)
                nodes[c][left] = _leaf(left, s["gl"], s["hl"], spec)
                nodes[c][left + 1] = _leaf(left + 1, s["g"] - s["gl"], s["h"] - s["hl"], spec)
                fresh[c] += [left, left + 1]
            open_nodes = fresh
        for c in clients:
            tree = sorted(nodes[c].values(), key=lambda n: n["id"])
            grown.append((round_no, c, tree_no, 1.0, [tuple(n[k] for k in (
                "id", "feature", "threshold", "left", "right", "leaf", "base_weight")) for n in tree]))
        if tree_no + 1 < spec.n_local_trees:
            moved = _moved_margins(rows, {c: in_bins(c) for c in clients if nodes[c]}, width, bins)
            rows = stage_at(moved, f"{base}/{tree_no + 1}")
            discard(spark, f"{base}/{tree_no}")
    discard(spark, base)
    return df.sparkSession.createDataFrame(grown, TREE_SCHEMA.replace(f"{CLIENT} int", f"{CLIENT} {kind}"))
