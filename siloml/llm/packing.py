"""Packing token sequences by reciprocal-capacity classes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from siloml.functions.staging import stage
from siloml.llm.common import join_measured
from siloml.llm.tokens import default_path, encoded_rows, encoder

CAPACITY = 4096
SLACK = 32  # a piece may leave 1 / SLACK of its class's slot unused; a longer document is cut


def piece_lengths(length: int, capacity: int) -> list[int]:
    """Cut a length into pieces that fill slots: a class k has k slots of capacity // k in a sequence.

    A piece takes the class k = capacity // length, whose slot is the smallest that holds it. If it leaves more
    than 1 / SLACK of the slot unused, a piece of the next smaller slot's full size is cut off it first.
    """
    out = [capacity] * (length // capacity)
    length %= capacity
    while length:
        slot = capacity // (capacity // length)
        if (slot - length) * SLACK > slot:
            slot = capacity // (capacity // length + 1)
            out.append(slot)
            length -= slot
        else:
            out.append(length)
            length = 0
    return out


def _pieces(path: str, capacity: int, with_ids: bool):
    """Encode and cut the documents of a task and fill the task's own sequences of every class.

    A class's open sequence is held back until its last slot is taken, so a task holds less than one sequence of
    each class; what is still open at its end is given without a sequence, numbered within its class.
    """
    names = ["part", "start", "length", "doc_tokens", "class", "seq", "offset", "place", "ids_crc32", "ids"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        cuts, held, closed, key = {}, {}, 0, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * (1 + len(names))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [key, *types])], names=["doc_id", *names])

        for b in batches:
            key, rows = b.schema.field(0).type, []
            for doc, ids in encoded_rows(enc, [b]):
                n, start = len(ids), 0
                if n not in cuts:
                    if len(cuts) > 100_000:
                        cuts = {}
                    cuts[n] = piece_lengths(n, capacity)
                for m in cuts[n]:
                    k, own = capacity // m, ids[start:start + m]
                    data = own.tobytes() if with_ids else None
                    bin_ = held.setdefault(k, [])
                    bin_.append((doc, start, m, n, zlib.crc32(own.astype("<u4").tobytes()), data))
                    if len(bin_) == k:
                        at = 0
                        for d, first, length, total, crc, x in bin_:
                            rows.append((d, part, first, length, total, k, closed, at, None, crc, x))
                            at += length
                        del held[k]
                        closed += 1
                    start += m
            yield batch(rows)
        if held:
            yield batch([(d, part, first, length, total, k, None, None, place, crc, x) for k, bin_ in held.items()
                         for place, (d, first, length, total, crc, x) in enumerate(bin_)])

    return run


def _fill(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """First fit by falling length: what is left of the classes after their last full sequence."""
        rows = rows.sort_values(["length", "class", "rank"], ascending=[False, True, True], kind="stable")
        room, bins, at = np.zeros(0, np.int64), [], []
        for m in rows["length"].to_numpy():
            fits = np.flatnonzero(room >= m)
            if not len(fits):
                room = np.append(room, capacity)
                fits = [len(room) - 1]
            bins.append(fits[0])
            at.append(capacity - room[fits[0]])
            room[fits[0]] -= m
        return rows.assign(bin=np.asarray(bins, np.int64), offset=np.asarray(at, np.int64))[
            ["class", "rank", "bin", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pack whole documents (doc_id, text) into sequences of at most ``capacity`` ids.

    Rows: doc_id, start, length, ids_crc32 (of the ids as unsigned 32-bit integers), doc_tokens, sequence_id, offset
    and, if asked for, ids (little endian, 2 bytes an id if the vocabulary allows, else 4); a row is a piece of a
    document. Documents are encoded (null text: empty; the end id follows each) and cut into pieces of the classes
    where they are read. Every class k fills its sequences with k pieces each, in every task by itself: no two
    tasks agree on open sequences and no ids are moved. The pieces of a task's open sequences, less than one
    sequence of a class, are numbered over all tasks and fill sequences of k again; what is left of a class after
    that is less than k pieces; these (20,000 at most for 4,096, whatever the input) are packed by first fit.
    Rows that repeat are documents of their own; an empty table gives no rows.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    fields = "part int, start bigint, length bigint, doc_tokens bigint, class int, seq bigint, offset bigint, place bigint, ids_crc32 bigint, ids binary"
    pieces = docs.select("doc_id", "text").mapInArrow(
        _pieces(tokenizer or default_path(), capacity, with_ids), f"doc_id {key}, {fields}")
    pieces = stage(pieces if with_ids else pieces.drop("ids"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    before = Window.rowsBetween(Window.unboundedPreceding, -1)

    # One row for each task that read the input.
    closed = pieces.groupBy("part").agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("closed"))
    firsts = stage(closed.select("part", "closed", F.coalesce(F.sum("closed").over(before.orderBy("part")), F.lit(0)).alias("first")))
    all_closed = firsts.agg(F.coalesce(F.sum("closed"), F.lit(0)).alias("all_closed"))
    whole = pieces.where("seq is not null").join(F.broadcast(firsts.select("part", "first")), "part").withColumn(
        "sequence_id", F.col("first") + F.col("seq"))

    # The tasks' open sequences: less than one of each class and task.
    open_ = pieces.where("seq is null").drop("seq", "offset")
    counts = open_.groupBy("class", "part").agg(F.count("*").alias("n"))
    starts = stage(counts.select("class", "part", F.coalesce(
        F.sum("n").over(before.partitionBy("class").orderBy("part")), F.lit(0)).alias("base")))
    # One row a class: at most 2 * sqrt(capacity).
    full = counts.groupBy("class").agg(F.expr("sum(n) div class").alias("full")).select(
        "class", "full", F.coalesce(F.sum("full").over(before.orderBy("class")), F.lit(0)).alias("first"),
        F.sum("full").over(Window.partitionBy()).alias("all_full")).crossJoin(all_closed).select(
        "class", "full", (F.col("first") + F.col("all_closed")).alias("first"), (F.col("all_full") + F.col("all_closed")).alias("used"))
    full = F.broadcast(stage(full))
    ranked = join_measured(open_, starts, ["class", "part"], "inner").withColumn(
        "rank", F.col("place") + F.col("base")).join(full, "class").withColumn("bin", F.expr("rank div class"))
    filled = ranked.where("bin < full").withColumn("sequence_id", F.col("first") + F.col("bin"))
    filled = filled.withColumn("offset", F.coalesce(
        F.sum("length").over(before.partitionBy("class", "bin").orderBy("rank")), F.lit(0)))
    rest = ranked.where("bin >= full")
    placed = stage(rest.select("class", "rank", "length", F.lit(0).alias("one")).groupBy("one").applyInPandas(
        _fill(capacity), "class int, rank bigint, bin bigint, offset bigint").withColumnRenamed("bin", "extra"))
    rest = rest.join(F.broadcast(placed), ["class", "rank"]).withColumn("sequence_id", F.col("used") + F.col("extra"))
    return whole.select(*out).unionByName(filled.select(*out)).unionByName(rest.select(*out))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (as in ``pack``, pieces by offset), n_ids. A sequence's pieces meet in one row."""
    piece = F.struct("offset", "ids")
    joined = F.aggregate(F.array_sort(F.collect_list(piece)), F.lit(b"").cast("binary"),
                         lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), joined.alias("ids"))
