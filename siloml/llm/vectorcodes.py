"""Vector codes by parts: small codebooks of integers, and cells of a grid that remember which entries can be nearest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siloml.functions.moments import matrix
from siloml.functions.staging import stage
from siloml.llm.common import join_measured

SCALE = 256  # Fixed value: a component x becomes floor(256 * x)
BOUND = 1 << 25  # scaled components are held inside, so that squared distances of vectors stay below 2^63
CELLS = 1 << 14  # cells that a task remembers for each part, a few MB; beyond, it starts anew


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    inf = float("inf")
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter vectors are filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(vectors) and (lengths == width).all():
        x = matrix(vectors)
    else:
        x = np.zeros((len(vectors), width))
        x[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(SCALE * x), -BOUND, BOUND).astype(np.int64)


class PartCoder:
    """Nearest entries (squared distance, then index) of one part's codebook.

    A point's coarse cell is a cube of the grid with edge 2^shift. For a cell met first, each entry's least and
    greatest distance to the cube are computed; entries whose least exceeds another one's greatest are nearest to
    no point in it, and the others are remembered. Only those are evaluated, exactly, for the cell's points.
    """

    def __init__(self, entries: np.ndarray, cells: int = CELLS):
        self.entries, self.cells = entries, cells
        m, d = entries.shape
        # Half the usual distance between an entry and its next: finer cells are met less often.
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        near = apart.min(axis=1)
        near = np.sqrt(near[(near > 0) & (near < np.iinfo(np.int64).max)])
        self.shift = int(np.log2(max(1.0, float(np.median(near)) / 2))) if len(near) else 25
        self.mixers = (np.arange(1, d + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.places: dict[int, int] = {}
        self.known = np.zeros((cells, d), np.int64)
        self.lists = np.zeros((cells, m), np.int32)
        self.sizes = np.zeros(cells, np.int64)

    def candidates(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries, ascending, that are not dominated across each cell (padded), and their number."""
        low = cells << self.shift
        high = low + (1 << self.shift) - 1
        below, above = low[:, None] - self.entries, self.entries - high[:, None]
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        most = (np.maximum(self.entries - low[:, None], high[:, None] - self.entries) ** 2).sum(axis=2)
        keep = least <= most.min(axis=1, keepdims=True)
        return np.argsort(~keep, axis=1, kind="stable").astype(np.int32), keep.sum(axis=1)

    def _slots(self, cells: np.ndarray) -> np.ndarray:
        """Places of the distinct cells in the memory; new ones are entered."""
        hashed = (cells.astype(np.uint64) * self.mixers).sum(axis=1, dtype=np.uint64)
        hashed ^= hashed >> np.uint64(29)
        distinct, first, of = np.unique(hashed, return_index=True, return_inverse=True)
        names, cell = distinct.tolist(), cells[first]
        new = [i for i, h in enumerate(names) if h not in self.places]
        if len(self.places) + len(new) > self.cells:
            self.places, new = {}, list(range(len(names)))
        at = np.arange(len(self.places), len(self.places) + len(new))
        self.known[at] = cell[new]
        self.lists[at], self.sizes[at] = self.candidates(cell[new])
        self.places.update(zip((names[i] for i in new), at.tolist()))
        slots = np.asarray([self.places[h] for h in names])[of]
        return np.where((self.known[slots] == cells).all(axis=1), slots, -1)  # -1: another cell has this hash

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row."""
        entry, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), self.cells):  # so many rows have no more cells than the memory holds
            some = slice(at, at + self.cells)
            entry[some], best[some] = self._nearest(x[some])
        return entry, best

    def _nearest(self, x):
        slots = self._slots(x >> self.shift)
        everything = np.arange(len(self.entries))
        sizes = np.where(slots >= 0, self.sizes[slots], len(everything))
        order = np.argsort(-sizes, kind="stable")
        ends = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # rows with more than j candidates
        rows, at = x[order], slots[order]
        entry, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for j, n in enumerate(ends.tolist()):
            e = np.where(at[:n] >= 0, self.lists[at[:n], j], j)
            d = ((rows[:n] - self.entries[e]) ** 2).sum(axis=1)
            nearer = d < best[:n]
            best[:n][nearer], entry[:n][nearer] = d[nearer], e[nearer]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return entry[back], best[back]


def _coders(codebooks: np.ndarray) -> list[PartCoder]:
    return [PartCoder(entries) for entries in codebooks]


def _assigned(coders: list[PartCoder], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows x parts: entries and squared distances."""
    cut = x.reshape(len(x), len(coders), -1)
    found = [c.nearest(np.ascontiguousarray(cut[:, p])) for p, c in enumerate(coders)]
    return np.stack([e for e, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def first_codebooks(vectors: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """parts x entries x width / parts: the parts of the vectors with the smallest ids, nulls last, ties by vector."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    x = integers(first.column(0).combine_chunks(), width)
    return np.ascontiguousarray(x.reshape(len(x), parts, width // parts).transpose(1, 0, 2))


def moved_codebooks(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floored mean of the parts that are nearest to it, if there are any.

    A task sends its sums by (part, entry), so the exchange and what reaches the driver have the codebooks' size.
    """
    parts, m, d = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, counts = _coders(codebooks), np.zeros((parts, m), np.int64)
        sums = np.zeros((parts, m, d), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column(0), parts * d)
            chosen, _ = _assigned(coders, x)
            cut = x.reshape(len(x), parts, d)
            for p in range(parts):
                counts[p] += np.bincount(chosen[:, p], minlength=m)
                np.add.at(sums[p], chosen[:, p], cut[:, p])
        p, e = np.nonzero(counts)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[p, e].ravel()), d).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), lists],
                                         names=["part", "entry", "n", "sums"])

    partial = vectors.select("embedding").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(d)])
    new = codebooks.copy()
    for r in total.collect():  # at most parts x entries rows
        new[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    return new


def fit_codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = parts * max(1, -(-longest // parts))
    codebooks = first_codebooks(vectors, parts, entries, width)
    for _ in range(rounds if codebooks.shape[1] else 0):
        codebooks = moved_codebooks(vectors, codebooks)
    return codebooks


def encode_vectors(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Codes of the vectors (vec_id, embedding, label), and the codebooks, parts x entries x components.

    Vectors that are null or hold null or non-finite components are left out. Components become floor(256 * x), cut
    off at +-2^25; vectors are filled up with zeros to a common multiple of ``parts``. Codebooks start at the vectors
    with the smallest ids (nulls last, ties by vector; fewer if there are fewer) and are moved ``rounds`` times over all
    vectors. Returns vec_id, label, codes (array<int>, one index a part) and error, the squared distances summed over
    the parts. Rows that repeat stay rows of their own; without vectors there are no rows.
    """
    vectors = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(whole(F.col("embedding")))
    codebooks = fit_codebooks(vectors, parts, entries, rounds)
    width = codebooks.shape[0] * codebooks.shape[2]
    key, kind = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(codebooks) if codebooks.shape[1] else []
        for b in batches:
            if not b.num_rows:
                continue
            chosen, d = _assigned(coders, integers(b.column(2), width))
            codes = pa.FixedSizeListArray.from_arrays(pa.array(chosen.astype(np.int32).ravel()), parts).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes, pa.array(d.sum(axis=1))],
                                             names=["vec_id", "label", "codes", "error"])

    return vectors.mapInArrow(run, f"vec_id {key}, label {kind}, codes array<int>, error bigint"), codebooks


def decode_vectors(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Add ``vector`` (array<bigint>), the entries of a row's codes joined."""
    parts, m, d = codebooks.shape
    table = F.lit([[e.tolist() for e in p] for p in codebooks])
    return codes.withColumn("vector", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.get(
        F.get(table, p), F.get("codes", p)))))


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the errors summed over the rows of an equal label; nulls are one label.

    Sums are pre-aggregated and come back as narrow rows, so no label gathers in one task.
    """
    rows = stage(coded)
    sums = stage(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return join_measured(rows, sums, F.col("label").eqNullSafe(F.col("of")), "inner").drop("of")
