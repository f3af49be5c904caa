"""Near-duplicate vectors by cosine: cover trees and their dual traversal."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siloml.functions.staging import stage
from siloml.llm.common import join_measured, least_labels

SAMPLE = 8192  # most vectors that the upper trees of large labels are fitted on, over all labels
CELL_ROWS = 16_384  # vectors of a label that one task compares with as many others
EDGE = 1e-7  # slack of the distance bounds; links themselves are decided on the dot product
BLOCK = 512  # nodes that are compared at once with WIDE others
WIDE = 4096
ROWS = 4096  # rows of a block where products are made row by row
CANDIDATES = 256  # points from which centers are chosen at once
MANY = 1024  # children from which a pair of nodes is a block by itself
SOME = 32  # children of both nodes from which all meet at once, in a block
PAIRS = 1 << 17  # pairs of nodes in a list
SINGLE = 0.05  # radius above which centers are chosen in single precision


def chord(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def _dots(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of the rows i of x with the rows j of y, in blocks."""
    out = np.empty(len(i))
    for s in range(0, len(i), ROWS):
        out[s:s + ROWS] = np.einsum("ij,ij->i", x[i[s:s + ROWS]], y[j[s:s + ROWS]])
    return out


def _cover(x: np.ndarray, first: int, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Centers more than ``r`` apart that cover all points, ``first`` among them: the place of each point's nearest
    center and the distance to it.

    Candidates are taken in batches, so that their distances are products of matrices. Single precision chooses
    centers of wide nodes only; the distances returned are of double precision.
    """
    z = x.astype(np.float32) if r > SINGLE else x
    near = 1 - r * r / 2
    owner, best = np.full(len(x), -1), np.full(len(x), -np.inf, z.dtype)
    rest, batch = np.arange(len(x)), np.asarray([first])  # rest: points that are no centers
    while len(batch):
        among = z[batch] @ z[batch].T >= near
        free, chosen = np.ones(len(batch), bool), []
        for k in range(len(batch)):
            if free[k]:
                chosen.append(k)
                free &= ~among[k]
        new = batch[chosen]
        owner[new], best[new] = new, np.inf
        rest = rest[best[rest] < np.inf]
        for s in range(0, len(rest), ROWS):
            at = rest[s:s + ROWS]
            dots = z[at] @ z[new].T
            top = dots.argmax(axis=1)
            dots = dots[np.arange(len(at)), top]
            closer = dots > best[at]
            owner[at[closer]], best[at[closer]] = new[top[closer]], dots[closer]
        batch = rest[best[rest] < near][:CANDIDATES]
    far = np.zeros(len(x))
    far[rest] = chord(_dots(x, x, rest, owner[rest]))
    return owner, far


class CoverTree:
    """Nested centers with halving radii: the children of a node at level k are 2^-k apart and cover its points.

    Points are unit vectors under chord distance. ``order`` lists the points so that a node's points are
    order[lo:hi]; ``radius`` is the real distance to the farthest of them. A node of one point, or of equal
    points, has no children.
    """

    def __init__(self, points: np.ndarray):
        self.center, self.radius, self.lo, self.hi, self.kids, self.level = [], [], [], [], [], []
        n, order = len(points), np.arange(len(points))
        todo = [(self._node(0, 0, n, 0, float(chord(points @ points[0]).max()) if n else 0.0), 2.0)] if n else []
        while todo:
            node, r = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo == 1 or self.radius[node] <= EDGE:
                continue
            while r >= self.radius[node]:
                r /= 2
            own = order[lo:hi].copy()
            first = int(np.flatnonzero(own == self.center[node])[0])
            owner, best = _cover(points[own], first, r)
            rank = np.argsort(owner, kind="stable")
            order[lo:hi] = own[rank]
            # Owners are the places of their centers; equal points that rounding keeps together are a node without children.
            centers, sizes = np.unique(owner, return_counts=True)
            if len(centers) == 1 and r < EDGE:
                continue
            ends = np.cumsum(sizes)
            far = np.zeros(len(own))
            np.maximum.at(far, owner, best)
            kids = [self._node(int(own[c]), lo + int(e - s), lo + int(e), self.level[node] + 1, float(f))
                    for c, e, s, f in zip(centers, ends, sizes, far[centers])]
            self.kids[node] = np.asarray(kids)[np.argsort(far[centers], kind="stable")]
            todo += [(k, r if len(kids) > 1 else r / 2) for k in kids if self.hi[k] - self.lo[k] > 1]
        self.order = order
        self.centers, self.reach = np.asarray(self.center, np.int64), np.asarray(self.radius)
        self.spans = np.asarray([self.lo, self.hi], np.int64).T.reshape(-1, 2)
        self.n_kids = np.asarray([0 if k is None else len(k) for k in self.kids], np.int64)
        self.first_kid = np.cumsum(self.n_kids) - self.n_kids
        self.all_kids = np.concatenate([np.zeros(0, np.int64), *(k for k in self.kids if k is not None)])

    def _node(self, center: int, lo: int, hi: int, level: int, radius: float) -> int:
        for name, v in zip(("center", "radius", "lo", "hi", "kids", "level"), (center, radius, lo, hi, None, level)):
            getattr(self, name).append(v)
        return len(self.center) - 1

    def net(self, least: int) -> np.ndarray:
        """Centers of the first level that has ``least`` or more, else of the finest; ``least`` of them at most."""
        finest = max(self.level, default=0)
        for level in range(finest + 1):
            now = [c for c, v, k in zip(self.center, self.level, self.kids) if v == level or v < level and k is None]
            if len(now) >= least or level == finest:
                return np.asarray(now[:least])
        return np.zeros(0, np.int64)


class Links:
    """Counts and connected groups of linked points; pairs are not kept."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.counts, self.root = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def count(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.counts, i, self.weights[j])
        np.add.at(self.counts, j, self.weights[i])
        self.join(i, j)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def traverse(a: CoverTree, b: CoverTree, xa: np.ndarray, xb: np.ndarray, least: float, links: Links, shift: int,
             same: bool) -> None:
    """Dual traversal: links of all pairs with a dot product of ``least`` or more; b's points count from ``shift``.

    A pair of nodes is dropped if no two of their points can be close enough, counted whole if all must be, else
    replaced by their children. ``same``: both are one tree, and each pair of points is seen once. Many children
    meet in blocks, as products of matrices; pairs of nodes with few children are taken together in long lists.
    """
    if not len(xa) or not len(xb):
        return
    most = float(np.sqrt(2 - 2 * least))
    za = xa.astype(np.float32)
    zb = za if xb is xa else xb.astype(np.float32)
    slack = 1e-5 + 2e-7 * xa.shape[1]  # more than the rounding of a dot product of unit vectors in single precision
    spans_a, spans_b = Spans(a, links, 0), Spans(b, links, shift)
    todo: list[tuple] = []  # (nodes of a, nodes of b, each with each?, both the same nodes?)

    def judge(u: np.ndarray, v: np.ndarray, dots: np.ndarray) -> None:
        d, reach = chord(dots), a.reach[u] + b.reach[v]
        keep = d <= most + reach + EDGE
        u, v, dots, d, reach = u[keep], v[keep], dots[keep], d[keep], reach[keep]
        itself = (u == v) if same else np.zeros(len(u), bool)
        one = (a.spans[u, 1] - a.spans[u, 0] == 1) & (b.spans[v, 1] - b.spans[v, 0] == 1)
        hit = one & ~itself & (dots >= least)
        links.count(a.centers[u[hit]], b.centers[v[hit]] + shift)
        # Nodes of equal points on both sides: their centers decide for all.
        even = (a.n_kids[u] == 0) & (b.n_kids[v] == 0) & ~one & ~itself
        sure = ~one & ~itself & np.where(even, dots >= least, d + reach < most - EDGE)
        spans_a.add(u[sure], spans_b.weight(v[sure]))
        spans_b.add(v[sure], spans_a.weight(u[sure]))
        links.join(a.centers[u[sure]], b.centers[v[sure]] + shift)
        spans_a.equal(u[itself & ~one & (a.n_kids[u] == 0)])
        rest = ~one & ~sure & ~even & ((a.n_kids[u] > 0) | (b.n_kids[v] > 0))
        u, v = u[rest], v[rest]
        both = (np.minimum(a.n_kids[u], b.n_kids[v]) >= SOME) | (u == v) & same
        size = np.where(both, a.n_kids[u] * b.n_kids[v], np.maximum(a.n_kids[u], b.n_kids[v]))
        for x, y, z in zip(*(c[size >= MANY].tolist() for c in (u, v, both))):
            if z:
                todo.append((a.kids[x], b.kids[y], True, same and x == y))
            elif down_a(np.asarray([x]), np.asarray([y]))[0]:
                todo.append((a.kids[x], np.asarray([y]), True, False))
            else:
                todo.append((np.asarray([x]), b.kids[y], True, False))
        u, v, size = u[size < MANY], v[size < MANY], size[size < MANY]
        for s in np.split(np.arange(len(u)), np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1):
            if len(s):
                todo.append((u[s], v[s], False, False))

    def down_a(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether the children of u, not of v, are to be met."""
        return (b.n_kids[v] == 0) | (a.n_kids[u] > 0) & (a.reach[u] >= b.reach[v])

    def lists(u: np.ndarray, v: np.ndarray) -> None:
        itself = (u == v) if same else np.zeros(len(u), bool)
        down = down_a(u, v)
        n_a, n_b = np.where(itself | down, a.n_kids[u], 1), np.where(itself | ~down, b.n_kids[v], 1)
        size = n_a * n_b
        pair = np.repeat(np.arange(len(u)), size)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        i, j = at // n_b[pair], at % n_b[pair]
        once = ~itself[pair] | (i <= j)
        pair, i, j = pair[once], i[once], j[once]
        x, y = u[pair], v[pair]
        in_a, in_b = (itself | down)[pair], (itself | ~down)[pair]
        x[in_a] = a.all_kids[a.first_kid[x[in_a]] + i[in_a]]
        y[in_b] = b.all_kids[b.first_kid[y[in_b]] + j[in_b]]
        judge(x, y, _dots(xa, xb, a.centers[x], b.centers[y]))

    def blocks(na: np.ndarray, nb: np.ndarray, own: bool) -> None:
        # Children come in the order of their reach: points first, and blocks of points by themselves.
        points = int(np.searchsorted(b.reach[nb], EDGE, "right"))
        cuts = sorted({*range(0, points, WIDE), *range(points, len(nb), WIDE), len(nb)})
        for s in range(0, len(na), BLOCK):
            pa_ = na[s:s + BLOCK]
            for lo, hi in zip(cuts, cuts[1:]):
                if own and hi <= s:
                    continue
                pb = nb[lo:hi]
                ca, cb = a.centers[pa_], b.centers[pb]
                # A first look in single precision, at the widest reach of the block; what it leaves is judged in double.
                wide = most + a.reach[pa_] + b.reach[pb].max() + EDGE
                i, j = np.nonzero(za[ca] @ zb[cb].T >= (1 - wide * wide / 2 - slack).astype(np.float32)[:, None])
                if own:  # a node with itself, and each pair of nodes once
                    once = s + i <= lo + j
                    i, j = i[once], j[once]
                if len(i):
                    whole = 16 * len(i) > len(pa_) * len(pb)
                    judge(pa_[i], pb[j], (xa[ca] @ xb[cb].T)[i, j] if whole else _dots(xa, xb, ca[i], cb[j]))

    judge(np.zeros(1, np.int64), np.zeros(1, np.int64), _dots(xa, xb, a.centers[:1], b.centers[:1]))
    while todo:
        u, v, crossed, own = todo.pop()
        blocks(u, v, own) if crossed else lists(u, v)
    spans_a.close()
    spans_b.close()


class Spans:
    """Links that hold for all points of a node: noted at the ends of the node's span, added up at the end."""

    def __init__(self, tree: CoverTree, links: Links, shift: int):
        self.links, self.order, self.spans = links, tree.order + shift, tree.spans
        n = len(tree.order) + 1
        self.before = np.concatenate(([0], np.cumsum(links.weights[self.order])))
        self.more, self.joined, self.equals = (np.zeros(n, np.int64) for _ in range(3))

    def weight(self, nodes: np.ndarray) -> np.ndarray:
        return self.before[self.spans[nodes, 1]] - self.before[self.spans[nodes, 0]]

    def add(self, nodes: np.ndarray, weight: np.ndarray) -> None:
        lo, hi = self.spans[nodes].T
        np.add.at(self.more, lo, weight)
        np.add.at(self.more, hi, -weight)
        np.add.at(self.joined, lo, 1)  # each point of the span with the next one
        np.add.at(self.joined, hi - 1, -1)

    def equal(self, nodes: np.ndarray) -> None:
        """All points of a node of equal points link with each other."""
        self.add(nodes, self.weight(nodes))
        np.add.at(self.equals, self.spans[nodes, 0], 1)
        np.add.at(self.equals, self.spans[nodes, 1], -1)

    def close(self) -> None:
        more, equals = np.cumsum(self.more)[:-1], np.cumsum(self.equals)[:-1]
        self.links.counts[self.order] += more - equals * self.links.weights[self.order]
        next_too = np.flatnonzero(np.cumsum(self.joined)[:-1] > 0)
        self.links.join(self.order[next_too], self.order[next_too + 1])


def _vectors(column, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def near_vectors(df: DataFrame, least: float = 0.98, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links of the vectors (vec_id, embedding, label) of equal label with a cosine of ``least`` or more.

    Returns for each row vec_id, n_links (other rows linked directly), component_id (the smallest vec_id that
    links reach, itself included) and kept (vec_id = component_id). Rows whose label is null, or whose vector is
    null, empty, zero or has a null or non-finite component, link with nothing; vectors of unlike length don't
    link. Equal vectors of a label are one weighted point. A label of up to ``cell_rows`` points is one task; a
    larger one is cut into cells around the centers of a cover tree over a bounded sample, dense cells by hash
    as well, and a task compares two cells. A point goes to another cell only if it could be within reach of it,
    by the cell's real covering radius, so no pair is lost. Tasks return counts and group roots, not pairs.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.size("embedding") > 0
    fine &= ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine &= F.exists("embedding", lambda v: v != 0) & F.col("label").isNotNull()
    rows = stage(df.select(
        "vec_id", "label", F.when(F.coalesce(fine, F.lit(False)), x).alias("x")).withColumns(
        {"h": F.when(F.col("x").isNotNull(), F.xxhash64("x")), "g": F.xxhash64(F.lit(1), "x")}))
    points = stage(rows.where("x is not null").groupBy("label", "h", "g").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.any_value("x").alias("x")).select(
        F.monotonically_increasing_id().alias("id"), "label", "h", "g", "weight", "least", "x",
        F.size("x").alias("dim")))
    large = points.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).collect()
    dealt = _dealt(points, {(r.label, r.dim): r.n for r in large}, least, cell_rows)

    def link(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        ids, weights = (table.column(c).to_numpy() for c in ("id", "weight"))
        v = _vectors(table.column("x"), dim)
        # Scaled first, so that squares of very large or small components stay finite.
        v = v / np.abs(v).max(axis=1, keepdims=True)
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links = Links(weights[np.concatenate((left, right))])
        tree = CoverTree(v[left])
        if len(right):
            traverse(tree, CoverTree(v[right]), v[left], v[right], least, links, len(left), False)
        elif table.column("i")[0].as_py() == table.column("j")[0].as_py():
            traverse(tree, tree, v[left], v[left], least, links, 0, True)
        ids = ids[np.concatenate((left, right))]
        hit = links.counts > 0
        return pa.table({"id": ids[hit], "n": links.counts[hit], "root": ids[links.root[hit]]})

    found = stage(dealt.groupBy("label", "dim", "i", "j").applyInArrow(link, "id bigint, n bigint, root bigint"))
    labels = least_labels(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = stage(found.groupBy("id").agg(F.sum("n").alias("n")).join(
        labels.withColumnRenamed("node", "id"), "id", "left"))
    linked = stage(join_measured(points.drop("x"), counts, "id").select(
        "label", "h", "g", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "id").alias("root"), "least"))
    smallest = stage(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    nodes = stage(join_measured(linked, smallest, "root", "inner").select(
        "label", "h", "g", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id"))
    out = join_measured(rows.select("vec_id", "label", "h", "g"), nodes, ["label", "h", "g"])
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _dealt(points: DataFrame, large: dict, least: float, cell_rows: int) -> DataFrame:
    """Points with the tasks (label, dim, i, j) that they go to, side 0 as points of cell i, 1 as points of cell j."""
    kind = dict(points.dtypes)["label"]
    base = ["id", "weight", "x", "label", "dim"]
    if not large:
        return points.select(*base, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    most = float(np.sqrt(2 - 2 * least))
    n = sum(large.values())
    # The same share of every large label, so the sample is bounded whatever their number.
    keys = points.sparkSession.createDataFrame([(*k, v) for k, v in large.items()], f"label {kind}, dim int, n bigint")
    keys = stage(keys)
    some = join_measured(points, keys, ["label", "dim"], "inner").where(
        F.pmod(F.xxhash64("h", F.lit(5)), F.lit(n)) < min(SAMPLE, n // 4)).select("label", "dim", "n", "x").limit(2 * SAMPLE).collect()
    samples = defaultdict(list)
    for r in some:
        samples[r.label, r.dim].append(r.x)

    def unit(v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

    nets = {}
    for key, vs in samples.items():
        v = unit(np.asarray(vs))
        nets[key] = v[CoverTree(v).net(max(1, 2 * large[key] // cell_rows))]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest center of each point of a large label, and its distance."""
        for b in batches:
            cell, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for key, at, v in _by_label(b):
                if key in nets:
                    dots = unit(v) @ nets[key].T
                    cell[at] = dots.argmax(axis=1)
                    far[at] = chord(dots.max(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    fields = f"id bigint, weight bigint, x array<double>, label {kind}, dim int"
    placed = stage(points.select(*base).mapInArrow(near, f"{fields}, cell int, far double"))
    # At most twice the sample's centers, bounded like the sample.
    cells = join_measured(placed, keys, ["label", "dim"], "inner").groupBy("label", "dim", "cell").agg(
        F.count("*").alias("n"), F.max("far").alias("far")).collect()
    table = defaultdict(list)  # by label: (center, radius, chunk, chunks)
    for r in sorted(cells, key=lambda r: r.cell):
        chunks = -(-r.n // cell_rows)
        table[r.label, r.dim] += [(r.cell, r.far, c, chunks) for c in range(chunks)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, i, j, side = [], [], [], []
            ids = b.column(0).to_numpy()
            for key, at, v in _by_label(b):
                if key not in table:
                    rows += [at]
                    i += [np.zeros(len(at), np.int32)]
                    j += [np.zeros(len(at), np.int32)]
                    side += [np.zeros(len(at), np.int32)]
                    continue
                net = nets.get(key)
                d = chord(unit(v) @ net.T) if net is not None else np.zeros((len(at), 1))
                own = b.column(5).to_numpy()[at]
                entry = np.asarray([t[0] for t in table[key]])
                chunks = np.asarray([t[3] for t in table[key]])
                chunk = np.asarray([t[2] for t in table[key]])
                # The point's own entry: its cell's chunk by a hash of its id.
                first = np.searchsorted(entry, own)
                home = first + (ids[at] * 2654435761 % (1 << 31)) % chunks[first]
                for k, (cell, far, c, _) in enumerate(table[key]):
                    go = np.flatnonzero((d[:, cell] <= far + most + EDGE) | (own == cell))
                    rows += [at[go]]
                    i += [np.minimum(home[go], k).astype(np.int32)]
                    j += [np.maximum(home[go], k).astype(np.int32)]
                    side += [(home[go] > k).astype(np.int32)]
            if rows:
                out = b.select(["id", "weight", "x", "label", "dim"]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, *(pa.array(np.concatenate(c)) for c in (i, j, side))],
                    names=[*out.schema.names, "i", "j", "side"])

    return placed.mapInArrow(deal, f"{fields}, i int, j int, side int")


def _by_label(b: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(label, dim), row places and vectors of a batch's labels."""
    labels, dims = b.column(3).to_pylist(), b.column(4).to_pylist()
    groups = defaultdict(list)
    for k, key in enumerate(zip(labels, dims)):
        groups[key].append(k)
    for key, at in groups.items():
        at = np.asarray(at)
        yield key, at, b.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, key[1])
