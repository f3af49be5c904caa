"""Fitting every silo by passes over its rows, with the fits' state as a table.

A pass is one Spark job for all silos: the silos' current vectors meet the blocks of their rows, tasks add up a
statistic for each silo, Spark sums it, and each silo's state moves on by it, in parallel over the silos. States
are rows (client_id, vector, memory, status, passes, residual) of a stored table; the driver holds a count of
the silos that are still running. A silo that ends, or can't be fitted, says so in its status and holds up no other.
Silos whose rows fit a task make all their passes there, in one job.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from siloml.functions.blocks import number_blocks
from siloml.functions.joins import attach, group_count
from siloml.functions.moments import FLUSH_VALUES, SALTS, matrix
from siloml.functions.staging import discard, stage_at, staging_dir
from siloml.spec import CLIENT, SPLIT, TRAIN, silo_type

SMALL_BYTES = 32 << 20  # features of a silo that makes all its passes in a task
BATCH_BYTES = 16 << 20  # of an Arrow batch of blocks in a pass
TASKS = 256  # tasks from which their sums are added up by salt first
RUNNING, OK, NOT_CONVERGED, NO_ROWS, NON_FINITE = "RUNNING", "OK", "NOT_CONVERGED", "NO_ROWS", "NON_FINITE"


class Machine(Protocol):
    """A trainer's rule: what is summed over a silo's rows at a vector, and how the silo moves on by it."""

    size: int  # of a vector

    def statistic(self, vector: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray: ...

    def advance(self, vector: np.ndarray, memory: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool, float]:
        """(next vector to be evaluated, memory, whether the fit has ended, residual). Memory is empty at first."""

    def best(self, vector: np.ndarray, memory: np.ndarray) -> np.ndarray: ...


def _partial_sums(blocks: DataFrame, live: DataFrame, machine: Machine, n_silos: int) -> DataFrame:
    """(client_id, salt, part): a task's sums of the machine's statistic, over the silos in ``live`` (client_id, vector)."""
    kind = silo_type(blocks)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        salt = TaskContext.get().partitionId() % SALTS
        schema = None

        def flush():
            rows = [{CLIENT: c, "salt": salt, "part": v.tolist()} for c, v in totals.items()]
            totals.clear()
            return pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            if not b.num_rows:
                continue
            schema = pa.schema([(CLIENT, b.column(0).type), ("salt", pa.int32()), ("part", pa.list_(pa.float64()))])
            vectors = matrix(b.column(4))
            for client, x, y, w, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), vectors):
                y, w = (np.frombuffer(c.as_buffer()) for c in (y, w))
                s = machine.statistic(v, np.frombuffer(x.as_buffer()).reshape(len(y), -1), y, w)
                totals[client] = totals[client] + s if client in totals else s
                if len(totals) * len(s) > FLUSH_VALUES:
                    yield flush()
        if totals:
            yield flush()

    joined = attach(blocks, live, [CLIENT], n_silos, 8 * machine.size + 64, salt_on="block")
    return joined.select(CLIENT, "x", "y", "w", "vector").mapInArrow(partial, f"{CLIENT} {kind}, salt int, part array<double>")


def _salted_sums(parts: DataFrame) -> DataFrame:
    """At most SALTS parts a silo, where there are so many tasks that one reader of all parts would be slow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            out = []
            for key, part in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), matrix(b.column(2)) if b.num_rows else ()):
                if key != at and at is not None:
                    out.append((*at, total))
                at, total = key, total + part if key == at else part.copy()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), b.schema)], names=b.schema.names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*at, total), b.schema)], names=b.schema.names)

    return parts.repartition(CLIENT, "salt").sortWithinPartitions(CLIENT, "salt").mapInArrow(run, parts.schema)


def _step(machine: Machine, vector, memory, status, passes, residual, sums, last: bool, at_end: str) -> tuple:
    """A silo's state after a pass."""
    if status != RUNNING:
        return vector, memory, status, passes, residual
    vector, memory, passes = np.asarray(vector), np.asarray(memory), passes + 1
    if not np.isfinite(sums).all():
        status = NON_FINITE
    else:
        vector, memory, done, residual = machine.advance(vector, memory, sums)
        status = OK if done else at_end if last else RUNNING
    if status != RUNNING:
        vector, memory = machine.best(vector, memory), memory[:0]
    return vector, memory, status, passes, residual


STATE = ("vector", "memory", "status", "passes", "residual")


def _moved(state: DataFrame, parts: DataFrame, machine: Machine, last: bool, at_end: str) -> DataFrame:
    """The states after a pass; silos that still run in the ``last`` one end with the status ``at_end``.

    A silo's state and then its parts stand together in a sorted partition, which is read as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, held, sums, schema = None, None, None, None
        for b in batches:
            schema, out = b.schema, []
            for i, (c, status) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                if status is None:
                    part = b.column(6)[i].values.to_numpy(zero_copy_only=False)
                    sums = part.copy() if sums is None else sums + part
                    continue
                if held is not None:
                    out.append((client, *_step(machine, *held, sums, last, at_end)))
                client, sums = c, None
                held = tuple(b.column(1 + k)[i].values.to_numpy() if k < 2 else b.column(1 + k)[i].as_py() for k in range(5))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], names=schema.names[:6])
        if held is not None:
            row = (client, *_step(machine, *held, sums, last, at_end))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], names=schema.names[:6])

    nothing = [F.lit(None).cast(state.schema[c].dataType).alias(c) for c in STATE]
    both = state.withColumn("part", F.lit(None).cast("array<double>")).unionAll(parts.select(CLIENT, *nothing, "part"))
    together = both.repartition(CLIENT).sortWithinPartitions(F.col(CLIENT), F.col("status").isNull())
    return together.mapInArrow(run, state.schema)


def _fit_whole(state: DataFrame, blocks: DataFrame, machine: Machine, passes: int, at_end: str) -> DataFrame:
    """The states of silos after all their passes, each silo's in a task.

    A silo's state and then its blocks stand together in a sorted partition; one silo's blocks are held at a time.
    """

    def fitted(held: tuple, blocks: list[tuple]) -> tuple:
        while held[2] == RUNNING:
            sums = None
            for x, y, w in blocks:
                s = machine.statistic(held[0], x, y, w)
                sums = s if sums is None else sums + s
            held = _step(machine, *held, sums, held[3] + 1 >= passes, at_end)
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, held, kept, schema = None, None, [], None
        for b in batches:
            schema, out = b.schema, []
            for i, (c, status) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                if status is None:
                    if held is not None and c == client and held[2] == RUNNING:  # a silo without a state is left out
                        x, y, w = (np.frombuffer(b.column(k)[i].as_py()) for k in (7, 8, 9))
                        kept.append((x.reshape(len(y), -1), y, w))
                    continue
                if held is not None:
                    out.append((client, *fitted(held, kept)))
                client, kept = c, []
                held = tuple(b.column(1 + k)[i].values.to_numpy().copy() if k < 2 else b.column(1 + k)[i].as_py() for k in range(5))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], names=schema.names[:6])
        if held is not None:
            row = (client, *fitted(held, kept))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], names=schema.names[:6])

    nothing = [F.lit(None).cast(state.schema[c].dataType).alias(c) for c in STATE]
    packed = ("block", "x", "y", "w")
    none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in packed]
    both = state.select("*", *none).unionAll(blocks.select(CLIENT, *nothing, *packed))
    # A given number of partitions, so that small tables don't end up in one of them.
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = both.repartition(tasks, CLIENT).sortWithinPartitions(F.col(CLIENT), F.col("status").isNull(), "block")
    return together.mapInArrow(run, state.schema)


@contextlib.contextmanager
def _batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of at most about ``size`` bytes in the jobs inside the block."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fit_silos(rows: DataFrame, machine: Machine, start: DataFrame | np.ndarray, passes: int, at_end: str = OK) -> DataFrame:
    """Fit the silos of ``rows`` (client_id, split, label, features, sample_weight): (client_id, vector, status, passes, residual).

    ``start``: one vector for all, or (client_id, vector). Every silo of ``rows`` gets a row: one without training
    rows has the status NO_ROWS, one with a null or non-finite value NON_FINITE, and both keep their start. At most
    ``passes`` passes are made; silos that run on end with ``at_end``. Silos of up to ``SMALL_BYTES`` of features make their
    passes in a task, by the same steps.
    """
    spark, base = rows.sparkSession, f"{staging_dir(rows.sparkSession)}/fit-{uuid.uuid4().hex}"
    blocks = stage_at(number_blocks(rows.where(F.col(SPLIT) == TRAIN)), f"{base}/blocks")
    found = blocks.groupBy(CLIENT).agg(F.sum("bad").alias("bad"), F.sum(F.length("x")).alias("bytes"))
    silos = rows.select(CLIENT).distinct().join(found, CLIENT, "left")
    if isinstance(start, DataFrame):
        silos = silos.join(start.select(CLIENT, "vector"), CLIENT)
    else:
        # A table of one row: as a literal, a long vector would be an expression for each number.
        one = spark.createDataFrame([([float(v) for v in start],)], "vector array<double>")
        silos = silos.crossJoin(F.broadcast(one))
    status = F.when(F.col("bad").isNull(), NO_ROWS).when(F.col("bad") > 0, NON_FINITE).otherwise(RUNNING)
    empty = F.array().cast("array<double>")
    state = silos.select(CLIENT, "vector", empty.alias("memory"), status.alias("status"), F.lit(0).alias("passes"),
                         F.lit(None).cast("double").alias("residual"), (F.col("bytes") <= SMALL_BYTES).alias("small"))
    state, path, running = _stored(state, f"{base}/0")
    with _batches_of(spark, BATCH_BYTES):
        if running and passes > 1:
            n_small = state.where((F.col("status") == RUNNING) & F.col("small")).count()
            if n_small:
                done = path
                few = (state, blocks) if n_small == running else (
                    state.where("small"), blocks.join(state.where("small").select(CLIENT), CLIENT, "left_semi"))
                ended = _fit_whole(few[0].drop("small"), few[1], machine, passes, at_end)
                if n_small < running:
                    ended = ended.unionByName(state.where("not coalesce(small, false)").drop("small"))
                state, path, running = _stored(ended, f"{base}/small")
                discard(spark, done)
        state = state.drop("small")
        n_silos, many = group_count(state, [CLIENT]) if running else 0, blocks.rdd.getNumPartitions() > TASKS
        for k in range(1, passes + 1):
            if not running:
                break
            live = state.where(F.col("status") == RUNNING).select(CLIENT, "vector")
            parts = _partial_sums(blocks, live, machine, n_silos)
            moved = _moved(state, _salted_sums(parts) if many else parts, machine, k == passes, at_end)
            done = path
            state, path, running = _stored(moved, f"{base}/{k}")
            discard(spark, done)
    discard(spark, f"{base}/blocks")
    return state.drop("memory")


def _stored(state: DataFrame, path: str) -> tuple[DataFrame, str, int]:
    """A stored state table and the number of silos in it that are running, counted as it is written."""
    seen = Observation()
    stored = stage_at(state.observe(seen, F.count_if(F.col("status") == RUNNING).alias("running")), path)
    return stored, path, seen.get["running"]


def require_fitted(fits: DataFrame) -> None:
    """Raise if any silo's fit has failed, with one of them."""
    words = {NOT_CONVERGED: "not optimal after its passes; raise max_iter or tol", NO_ROWS: "no training rows",
             NON_FINITE: "null, NaN or infinite values in its training rows"}
    failed = fits.where(F.col("status") != OK).groupBy("status").agg(
        F.count("*").alias("n"), F.first(CLIENT).alias("silo"), F.max("residual").alias("worst")).collect()
    if failed:
        raise ValueError("; ".join(f"{r.n} silos, e.g. {r.silo}: {words.get(r.status, r.status)}"
                                   + (f" (worst residual {r.worst:.3g})" if r.worst is not None else "") for r in failed))
