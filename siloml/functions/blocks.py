"""Rows of a silo packed into blocks, so that a silo's model travels once for some thousand rows.

Partitions are sorted by silo (which spills, and moves nothing), and each Arrow batch is cut where the silo
changes. A block holds at most a batch of rows of one silo; a silo of any size is many blocks in many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siloml.functions.joins import attach
from siloml.functions.moments import by_silo, matrix
from siloml.spec import CLIENT, FEATURES, LABEL, silo_type


def _numbered() -> Iterator[int]:
    at = TaskContext.get().partitionId() << 40
    while True:
        yield at
        at += 1


def number_blocks(df: DataFrame) -> DataFrame:
    """(client_id, block, n, bad, x, y, w) of rows (client_id, label, features, sample_weight).

    x, y and w are the bytes of doubles (x row by row); ``bad`` counts rows with a null or non-finite number.
    """
    kind = silo_type(df)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbered()
        for b in batches:
            if not b.num_rows:
                continue
            clients, label, features, weight = b.columns
            x = matrix(features)
            y, w = (c.to_numpy(zero_copy_only=False).astype(float) for c in (label, weight))
            bad = ~(np.isfinite(x).all(axis=1) & np.isfinite(y) & np.isfinite(w))
            out = [(c, next(numbers), len(r), int(bad[r].sum()), x[r].tobytes(), y[r].tobytes(), w[r].tobytes())
                   for c, r in by_silo(clients.to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*out), (clients.type, pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3))],
                names=[CLIENT, "block", "n", "bad", "x", "y", "w"])

    rows = df.select(CLIENT, LABEL, FEATURES, "sample_weight").sortWithinPartitions(CLIENT)
    return rows.mapInArrow(pack, f"{CLIENT} {kind}, block bigint, n int, bad int, x binary, y binary, w binary")


def in_blocks(df: DataFrame) -> DataFrame:
    """(client_id, block, rows array<struct of df's columns>)."""
    names, kind, inner = df.columns, silo_type(df), df.schema.simpleString()
    client = names.index(CLIENT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbered()
        for b in batches:
            if not b.num_rows:
                continue
            order, ends, found = [], [0], []
            for c, r in by_silo(b.column(client).to_numpy(zero_copy_only=False)):
                order.append(r)
                ends.append(ends[-1] + len(r))
                found.append(c)
            t = b.take(pa.array(np.concatenate(order)))
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(t.columns, names=names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, b.column(client).type), pa.array([next(numbers) for _ in found], pa.int64()), rows],
                names=[CLIENT, "block", "rows"])

    return df.sortWithinPartitions(CLIENT).mapInArrow(pack, f"{CLIENT} {kind}, block bigint, rows array<{inner}>")


def with_side(blocks: DataFrame, side: DataFrame, value: str, n_silos: int, row_bytes: int, how: str = "inner") -> DataFrame:
    """(client_id, rows, value): the blocks and what their silo has in ``side`` (client_id, value)."""
    return attach(blocks, side.select(CLIENT, value), [CLIENT], n_silos, row_bytes, how, "block").select(CLIENT, "rows", value)


def map_with_side(
    df: DataFrame,
    side: DataFrame,
    value: str,
    score: Callable[[object, np.ndarray], Sequence],
    added: str,
    n_silos: int,
    row_bytes: int,
    read: Callable[[object], object] = lambda v: v,
) -> DataFrame:
    """Add columns ``added`` (DDL) = ``score(the silo's value, features)`` to every row of ``df``.

    ``side`` (client_id, value) is joined to blocks of rows; ``score`` gets the value as Python objects (dicts and
    lists), as ``read`` gives it, and is called once for a block; a value is read once for blocks in a row that share it.
    Rows of silos that the side lacks are left out.
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL(added).fields])
    names, arrow = df.columns, to_arrow_schema(schema)
    place = names.index(FEATURES)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = known = None
        for b in batches:
            for i in range(b.num_rows):
                columns = b.column(1).slice(i, 1).flatten().flatten()
                here = b.column(2).slice(i, 1)
                if cell is None or not here.equals(cell):
                    # A copy, so that the batch that it stands in is not kept.
                    cell, known = pa.concat_arrays([here, here[:0]]), read(here[0].as_py())
                out = score(known, matrix(columns[place]))
                yield pa.RecordBatch.from_arrays(
                    [*columns, *[pa.array(v, arrow.field(len(names) + k).type) for k, v in enumerate(out)]], names=arrow.names)

    return with_side(in_blocks(df), side, value, n_silos, row_bytes).mapInArrow(unpack, schema)
