"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from siloml.functions.staging import stage

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# Fixed value: rows up to which a measured side table is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_measured(df: DataFrame, side: DataFrame, on, how: str = "left") -> DataFrame:
    """Join with a side that is already stored: broadcast if its counted rows are few, else shuffled.

    The side's rows must be narrow (ids and numbers). A shuffled join leaves hot keys to adaptive execution.
    """
    few = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if few else side, on, how)


def _running(batches):
    """Rows of a sorted partition with the partition's number, and sizes and rows before each of them."""
    part, total, rows = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = total + np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(np.full(n, part, np.int32)), pa.array(ends - size),
             pa.array(np.arange(rows, rows + n, dtype=np.int64))],
            names=["row", "size", "part", "before", "index"],
        )
        total, rows = int(ends[-1]), rows + n


def prefix_sums(df: DataFrame, order: Sequence[Column], size: Column) -> DataFrame:
    """Global running totals in ``order``: columns ``row`` (a struct of df's columns), ``size``, ``before``, ``index``.

    ``before`` and ``index`` are the summed sizes and the number of the rows that precede a row. Rows are dealt
    into sorted ranges, each range sums up its own rows, and the ranges' totals (one row for each partition)
    give every range its start. The ranges are stored once, so that totals and rows always agree, also after a
    lost executor. Rows that tie in ``order`` may come in any order. ``size`` must not be null.
    """
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), size.cast("bigint").alias("size"), *keys)
    dealt = rows.repartitionByRange(parts(df), *names).sortWithinPartitions(*names).select("row", "size")
    schema = f"row {dealt.schema['row'].dataType.simpleString()}, size bigint, part int, before bigint, index bigint"
    stored = stage(dealt.mapInArrow(_running, schema))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("part").agg(F.sum("size").alias("s"), F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base_rows"))
    # One row for each partition of the range shuffle: bounded by spark.sql.shuffle.partitions.
    return stored.join(F.broadcast(starts), "part").select(
        "row", "size", (F.col("before") + F.col("base")).alias("before"),
        (F.col("index") + F.col("base_rows")).alias("index"))


def least_labels(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b of one orderable type): (node, root), root the component's least node.

    Every node takes the least node among itself and its neighbours, then its neighbours are rewired to that
    node, until no edge joins anything but a node and its root. A round is one aggregation and one join, stored,
    so a hub with many links is pre-aggregated before the shuffle and no component gathers in one task. Rounds
    grow with the logarithm of the longest chain.
    """
    now = stage(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # Large star: what a node sees above itself goes to the least node that it sees.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stage(join_measured(both.where("v > u"), least, "u", "inner").select(
            F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: what a node sees below itself, and the node, go to the least of these.
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = join_measured(large, least, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
        new = stage(small.where("a != b").distinct())
        same = F.bit_xor(F.xxhash64("a", "b")), F.count("*")
        if new.agg(*same).first() == now.agg(*same).first():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                new.select("b", "b").distinct())
        now = new
