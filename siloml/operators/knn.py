"""Exact k nearest neighbours inside groups, by pruned block joins.

1. Equal vectors are collapsed to one point that keeps its k+1 smallest row ids, so a large group of
   copies is one point (no k nearest list needs more of them).
2. A median tree grown on a bounded sample cuts each group into leaves; every leaf's exact bounding box
   is computed from the data.
3. Each point searches its own leaf, which bounds the distance of its k-th neighbour from above.
4. A point visits another leaf only if that leaf's box is closer than its bound.
5. Both searches run as cogrouped numpy blocks, which cut a leaf into small boxes and compare a visitor only
   with the boxes inside its bound; leaf points and visitors are cut into chunks, so no task holds an unbounded
   group. The k best of all visits remain: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siloml.functions.hashing import hash32
from siloml.functions.joins import attach, join_hot
from siloml.functions.moments import by_silo, matrix
from siloml.functions.staging import stage
from siloml.spec import CLIENT, FEATURES, ROW_ID, silo_type

LEAF_ROWS = 16_384  # aimed points per leaf
BOX_ROWS = 64  # aimed points per box inside a leaf
VISITORS = 2048  # visitors of a leaf that are compared with its boxes at once
SAMPLE_ROWS = 500_000  # over all groups, for the trees
LEAVES = 65_536  # over all groups; leaves that come out larger are searched in chunks
CHUNK_ROWS = 65_536  # leaf points or visitors per task group

NEAR_TYPE = pa.list_(pa.struct([("d2", pa.float64()), ("nbr_id", pa.int64())]))


def _grow(sample: np.ndarray, leaves: int) -> list[tuple]:
    """Median tree as a list of nodes (dim, cut, left, right); a leaf is (-1, 0.0, leaf number, -1)."""
    nodes: list = [None]
    todo = [(0, sample, leaves)]
    n_leaf = 0
    while todo:
        at, pts, want = todo.pop(0)
        spread = np.ptp(pts, axis=0) if len(pts) else np.zeros(1)
        dim = int(np.argmax(spread))
        cut = float(np.median(pts[:, dim])) if len(pts) > 1 else 0.0
        left = pts[:, dim] < cut if len(pts) > 1 else np.zeros(len(pts), bool)
        if want < 2 or spread[dim] == 0 or not left.any():
            nodes[at] = (-1, 0.0, n_leaf, -1)
            n_leaf += 1
            continue
        a, b = len(nodes), len(nodes) + 1
        nodes[at] = (dim, cut, a, b)
        nodes += [None, None]
        todo += [(a, pts[left], want // 2), (b, pts[~left], want - want // 2)]
    return nodes


def _leaf_of(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    at = np.zeros(len(x), dtype=np.int64)
    table = np.array(nodes, dtype=float)
    while True:
        dim = table[at, 0].astype(int)
        inner = dim >= 0
        if not inner.any():
            return table[at, 2].astype(np.int32)
        go_left = x[np.arange(len(x)), np.maximum(dim, 0)] < table[at, 1]
        child = np.where(go_left, table[at, 2], table[at, 3]).astype(np.int64)
        at = np.where(inner, child, at)


def _squared(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances, added dimension by dimension (the same order as a written-out sum)."""
    out = np.zeros((len(q), len(p)))
    for d in range(q.shape[1]):
        out += np.square(q[:, d, None] - p[None, :, d])
    return out


def _best_points(d2: np.ndarray, firsts: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k nearest points (all of them if fewer), by distance, then first row id."""
    if d2.shape[1] <= k:
        near = np.broadcast_to(np.arange(d2.shape[1]), d2.shape)
    else:
        near = np.argpartition(d2, k - 1, axis=1)[:, :k]
        limit = np.take_along_axis(d2, near, axis=1).max(axis=1)
        for row in np.flatnonzero((d2 <= limit[:, None]).sum(axis=1) > k):  # ties at the k-th distance
            tied = np.flatnonzero(d2[row] <= limit[row])
            near[row] = tied[np.lexsort((firsts[tied], d2[row, tied]))][:k]
    order = np.lexsort((firsts[near], np.take_along_axis(d2, near, axis=1)), axis=1)
    return np.take_along_axis(near, order, axis=1)


def _within(q: np.ndarray, bound: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, cuts: np.ndarray,
            k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(visitor, point, d2) of all points that may be among the k nearest of a visitor, by boxes of points p[cuts[i]:cuts[i + 1]].

    A visitor's bound is what the box closest to it leaves; ``bound`` is what was known before.
    """
    gap = np.zeros((len(q), len(lo)))
    for d in range(q.shape[1]):
        v = q[:, d, None]
        gap += np.square(np.maximum(np.maximum(lo[None, :, d] - v, v - hi[None, :, d]), 0.0))
    gap[np.isnan(gap)] = 0.0  # a box of points without a value: they come last
    first = gap.argmin(axis=1)
    bound = bound.copy()
    found = []

    def meet(rows: np.ndarray, boxes: np.ndarray) -> None:
        order = np.argsort(boxes, kind="stable")
        rows, boxes = rows[order], boxes[order]
        ends = np.flatnonzero(np.diff(boxes, append=-1)) + 1
        for s, e in zip(np.concatenate(([0], ends[:-1])), ends):
            at, start = rows[s:e], cuts[boxes[s]]
            d2 = _squared(q[at], p[start:cuts[boxes[s] + 1]])
            if d2.shape[1] >= k:
                bound[at] = np.fmin(bound[at], np.partition(d2, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(~(d2 > bound[at, None]))
            found.append((at[i], start + j, d2[i, j]))

    meet(np.arange(len(q)), first)
    # A small slack keeps boxes whose distance differs from the bound by rounding only.
    near = gap <= bound[:, None] * (1 + 1e-9) + 1e-12
    near[np.arange(len(q)), first] = False
    meet(*np.nonzero(near))
    visitor, point, d2 = (np.concatenate(c) for c in zip(*found))
    keep = ~(d2 > bound[visitor])
    return visitor[keep], point[keep], d2[keep]


def _search(k: int):
    """Cogroup kernel: visitors x leaf points -> the k+1 nearest rows of each visitor, as far as its bound allows.

    The leaf's points are cut into boxes of about BOX_ROWS by a median tree of their own.
    """

    def kernel(visitors: pa.Table, points: pa.Table) -> pa.Table:
        client = visitors.schema.field(f"v_{CLIENT}").type
        if visitors.num_rows == 0 or points.num_rows == 0:
            return pa.table({CLIENT: pa.array([], client), "q": pa.array([], pa.int64()), "near": pa.array([], NEAR_TYPE)})
        q, p = (matrix(t.column(c).combine_chunks()) for t, c in ((visitors, "q_vec"), (points, "vec")))
        bound = visitors.column("bound").to_numpy().astype(float)
        bound = np.where(np.isnan(bound), np.inf, bound)
        known = ~np.isnan(p).any(axis=1)
        nodes = _grow(p[known], -(-int(known.sum()) // BOX_ROWS))
        leaf = _leaf_of(p, nodes)
        order = np.argsort(leaf, kind="stable")
        given, p, firsts = p, p[order], points.column("point").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(leaf[order])) + 1, [len(p)]))
        lo, hi = np.fmin.reduceat(p, cuts[:-1]), np.fmax.reduceat(p, cuts[:-1])
        lists = points.column("ids").combine_chunks().take(pa.array(order))
        sizes, ids = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        # Visitors that are close to each other come together, so that they meet the same boxes.
        rank = np.argsort(_leaf_of(q, nodes), kind="stable")
        blank = np.isnan(q[rank]).any(axis=1)
        rows, d2s, found = [], [], []
        place = np.empty(len(p), np.int64)
        place[order] = np.arange(len(p))

        def no_distance(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Any points do for a visitor that lacks a value."""
            near = _best_points(_squared(q[at], given), firsts, k + 1)
            return np.repeat(np.arange(len(at)), near.shape[1]), place[near.ravel()], np.full(near.size, np.nan)

        blocks = [(part[s:s + step], lacking) for part, step, lacking in (
            (rank[~blank], VISITORS, False), (rank[blank], max(1, 4_000_000 // len(p)), True)) for s in range(0, len(part), step)]
        for at, lacking in blocks:
            visitor, point, d2 = no_distance(at) if lacking else _within(q[at], bound[at], p, lo, hi, cuts, k + 1)
            n = sizes[point]
            each = np.repeat(starts[point] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            visitor, d2, nbr = np.repeat(visitor, n), np.repeat(d2, n), ids[each]
            by = np.lexsort((nbr, d2, visitor))
            visitor, d2, nbr = visitor[by], d2[by], nbr[by]
            best = np.arange(len(by)) - np.searchsorted(visitor, visitor) <= k
            rows, d2s, found = [*rows, at[visitor[best]]], [*d2s, d2[best]], [*found, nbr[best]]
        rows = np.concatenate(rows)
        firsts = np.flatnonzero(np.diff(rows, prepend=-1))
        # Distances that are not known are null.
        near = pa.ListArray.from_arrays(
            pa.array(np.concatenate((firsts, [len(rows)])).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(np.concatenate(d2s), from_pandas=True), pa.array(np.concatenate(found))], names=["d2", "nbr_id"]))
        names = visitors.column("q").to_numpy()[rows[firsts]]
        return pa.table({CLIENT: pa.array(np.full(len(firsts), visitors.column(f"v_{CLIENT}")[0].as_py()), client),
                         "q": pa.array(names), "near": near.cast(NEAR_TYPE)})

    return kernel


def _kernel_schema(kind: str) -> str:
    return f"{CLIENT} {kind}, q bigint, near array<struct<d2: double, nbr_id: bigint>>"


def _place(points: DataFrame, trees: dict):
    """(points with their leaf, chunks per leaf, broadcast leaf boxes)."""
    spark, kind = points.sparkSession, silo_type(points)
    tree_var = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("vec"))
            leaf = np.zeros(len(x), dtype=np.int32)
            for client, rows in by_silo(batch.column(CLIENT).to_numpy(zero_copy_only=False)):
                if client in tree_var.value:
                    leaf[rows] = _leaf_of(x[rows], tree_var.value[client])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    points = stage(points.select(CLIENT, "point", "ids", "vec").mapInArrow(
        place, f"{CLIENT} {kind}, point bigint, ids array<bigint>, vec array<double>, leaf int"
    ))

    corner = points.select(CLIENT, "leaf", F.posexplode("vec").alias("pos", "x"))
    boxes_df = corner.groupBy(CLIENT, "leaf", "pos").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")
    ).groupBy(CLIENT, "leaf").agg(
        F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("box"), F.max("n").alias("n")
    )
    boxes_df = stage(boxes_df)
    boxes: dict[int, tuple] = {}
    treed = spark.createDataFrame([(c,) for c in trees], f"{CLIENT} {kind}")
    for r in boxes_df.join(F.broadcast(treed), CLIENT).collect():  # at most LEAVES rows
        entry = boxes.setdefault(r[CLIENT], ([], [], []))
        entry[0].append(r["leaf"])
        entry[1].append([b["lo"] for b in r["box"]])
        entry[2].append([b["hi"] for b in r["box"]])
    box_var = spark.sparkContext.broadcast({c: tuple(np.array(a) for a in e) for c, e in boxes.items()})
    chunk_df = boxes_df.select(CLIENT, "leaf", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("n_chunks"))
    return points, chunk_df, box_var


def _visit(visits: DataFrame, points: DataFrame, chunk_df: DataFrame, n_leaves: int, k: int) -> DataFrame:
    """visits (client_id, q, q_vec, leaf, bound) against the leaves' points."""
    load = visits.groupBy(CLIENT, "leaf").agg(F.count("*").alias("n_visits"))
    plan = load.join(chunk_df, [CLIENT, "leaf"]).select(
        CLIENT, "leaf", "n_chunks", F.ceil(F.col("n_visits") / CHUNK_ROWS).cast("int").alias("n_parts")
    )
    left = attach(visits, plan, [CLIENT, "leaf"], n_leaves, 64, salt_on="q").withColumn(
        "part", F.pmod(F.xxhash64("q"), F.col("n_parts")).cast("int")
    ).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    right = attach(points, plan, [CLIENT, "leaf"], n_leaves, 64, salt_on="point").withColumn(
        "chunk", F.pmod(F.xxhash64("point"), F.col("n_chunks")).cast("int")
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    # Both sides come from the same table, so each gets key columns of its own.
    keys = (CLIENT, "leaf", "chunk", "part")
    left_keys = [F.col(c).alias(f"v_{c}") for c in keys]
    right_keys = [F.col(c).alias(f"p_{c}") for c in keys]
    left = left.select(*left_keys, "q", "q_vec", "bound").groupBy(*[f"v_{c}" for c in keys])
    right = right.select(*right_keys, "point", "ids", "vec").groupBy(*[f"p_{c}" for c in keys])
    return left.cogroup(right).applyInArrow(_search(k), _kernel_schema(silo_type(points)))


def _reach(asked: DataFrame, home: DataFrame, box_var, k: int) -> DataFrame:
    """Visits to other leaves whose box is closer than the query's k-th neighbour so far."""
    # The k+1st row known so far (the point's own row is one) bounds the search.
    bound = home.groupBy(CLIENT, "q").agg(F.min(F.get("near", F.lit(k))["d2"]).alias("bound"))
    bounded = asked.drop("bound").join(bound, [CLIENT, "q"], "left")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            schema = pa.schema([
                (CLIENT, batch.schema.field(CLIENT).type), ("q", pa.int64()), ("q_vec", pa.list_(pa.float64())),
                ("leaf", pa.int32()), ("bound", pa.float64()),
            ])
            x = matrix(batch.column("q_vec"))
            own = batch.column("leaf").to_numpy(zero_copy_only=False)
            limit = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            limit = np.where(np.isnan(limit), np.inf, limit)
            for client, rows in by_silo(batch.column(CLIENT).to_numpy(zero_copy_only=False)):
                if client not in box_var.value:
                    continue
                leaves, lo, hi = box_var.value[client]
                for s in range(0, len(rows), 512):
                    r = rows[s:s + 512]
                    gap = np.zeros((len(r), len(leaves)))
                    for d in range(x.shape[1]):
                        v = x[r, d, None]
                        gap += np.square(np.maximum(np.maximum(lo[None, :, d] - v, v - hi[None, :, d]), 0.0))
                    # A small slack keeps boxes whose distance differs from the bound by rounding only.
                    go = (gap <= limit[r, None] * (1 + 1e-9) + 1e-12) & (leaves[None, :] != own[r, None])
                    qi, li = np.nonzero(go)
                    if len(qi):
                        take = pa.array(r[qi])
                        yield pa.RecordBatch.from_arrays([
                            batch.column(CLIENT).take(take), batch.column("q").take(take),
                            batch.column("q_vec").take(take), pa.array(leaves[li].astype(np.int32)),
                            batch.column("bound").take(take),
                        ], schema=schema)

    return bounded.select(CLIENT, "q", "q_vec", "leaf", "bound").mapInArrow(
        reach, f"{CLIENT} {silo_type(asked)}, q bigint, q_vec array<double>, leaf int, bound double"
    )


def knn(df: DataFrame, k: int, n_groups: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """k nearest other rows of every row in its ``client_id`` group.

    ``df``: (client_id, row_id, features). Order: squared distance, then row id.
    Returns (client_id, row_id, nbr_rank 1..k, nbr_id, d2).
    """
    spark = df.sparkSession
    copies = Window.partitionBy(CLIENT, FEATURES).orderBy(ROW_ID)
    few = df.select(CLIENT, ROW_ID, FEATURES).withColumn("_rn", F.row_number().over(copies)).where(f"_rn <= {k + 1}")
    points = few.groupBy(CLIENT, FEATURES).agg(
        F.min(ROW_ID).alias("point"), F.sort_array(F.collect_list(ROW_ID)).alias("ids")
    ).withColumnRenamed(FEATURES, "vec")
    points = stage(points)

    sizes = {r[CLIENT]: r["n"] for r in points.groupBy(CLIENT).agg(F.count("*").alias("n")).collect()}
    # Only groups above one leaf get a tree; the sample and leaf budgets are shared in proportion to size, so
    # neither grows with the data or the number of groups. A group left without a tree is one leaf, searched
    # in chunks.
    large = {c: n for c, n in sizes.items() if n > leaf_rows}
    trees = {}
    if large:
        total = sum(large.values())
        share = min(1.0, SAMPLE_ROWS / total) * 2.0 ** 32
        wanted = spark.createDataFrame([(c,) for c in large], f"{CLIENT} {silo_type(df)}")
        sampled = points.join(F.broadcast(wanted), CLIENT).where(hash32(17, "point") < F.lit(share))
        vectors: dict[int, list] = {}
        for row in sampled.select(CLIENT, "vec").collect():  # about SAMPLE_ROWS rows at most
            vectors.setdefault(row[CLIENT], []).append(row["vec"])
        for c, vecs in vectors.items():
            leaves = min(-(-large[c] // leaf_rows), max(1, LEAVES * large[c] // total))
            trees[c] = _grow(np.array(vecs, dtype=float), leaves)
    if trees:
        points, chunk_df, box_var = _place(points, trees)
    else:
        points, box_var = points.withColumn("leaf", F.lit(0)), None
        chunk_df = spark.createDataFrame(
            [(c, 0, -(-n // CHUNK_ROWS)) for c, n in sizes.items()], f"{CLIENT} {silo_type(df)}, leaf int, n_chunks int")
    n_leaves = len(sizes) + LEAVES
    asked = points.select(CLIENT, F.col("point").alias("q"), F.col("vec").alias("q_vec"), "leaf", F.lit(None).cast("double").alias("bound"))
    home = _visit(asked, points, chunk_df, n_leaves, k)
    if trees:
        home = stage(home)
        away = _reach(asked, home, box_var, k)
        found = home.unionByName(_visit(stage(away), points, chunk_df, n_leaves, k))
    else:  # one leaf per group: the home search has seen everything
        found = home
    lists = found.groupBy(CLIENT, "q").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))

    # Every row of a point shares its list; it drops itself and keeps the first k.
    by_point = points.select(CLIENT, F.col("point").alias("q"), F.col("vec").alias(FEATURES)).join(lists, [CLIENT, "q"])
    n_rows = df.count()
    rows = join_hot(df.select(CLIENT, ROW_ID, FEATURES), by_point.drop("q"), [CLIENT, FEATURES], n_rows)
    own = F.slice(F.filter("near", lambda s: s["nbr_id"] != F.col(ROW_ID)), 1, k)
    return rows.select(CLIENT, ROW_ID, F.posexplode(own).alias("_p", "_s")).select(
        CLIENT, ROW_ID, (F.col("_p") + 1).alias("nbr_rank"), F.col("_s.nbr_id").alias("nbr_id"),
        F.col("_s.d2").alias("d2"),
    )
