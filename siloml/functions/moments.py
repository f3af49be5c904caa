"""Per-silo sums of vector statistics: numpy over Arrow batches inside tasks, summed by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from siloml.spec import CLIENT, FEATURES, silo_type

SALTS = 32
FLUSH_VALUES = 16_000_000  # doubles held by one task before it emits its partial sums


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """An Arrow array<double> column of equal lengths as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def by_silo(clients: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(client, row positions) of a batch."""
    order = np.argsort(clients, kind="stable")
    values, starts = np.unique(clients[order], return_index=True)
    for value, rows in zip(values, np.split(order, starts[1:])):
        yield int(value), rows


def silo_sums(
    df: DataFrame,
    statistic: Callable[[int, np.ndarray, dict[str, np.ndarray]], np.ndarray],
    extra: Sequence[str] = (),
    features: str = FEATURES,
) -> DataFrame:
    """(client_id, sums array<double>): ``statistic(client, X, extra columns)`` added up over all rows.

    A task keeps one running vector per silo it meets, so the shuffle carries tasks x silos vectors
    whatever the row count; a salt first spreads the vectors of one silo over several reducers.
    """
    extra = list(extra)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def flush():
            rows = [{CLIENT: c, "salt": salt, "part": v.tolist()} for c, v in totals.items()]
            totals.clear()
            return pa.RecordBatch.from_pylist(rows, schema)

        schema = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kind = batch.schema.field(CLIENT).type
            schema = pa.schema([(CLIENT, kind), ("salt", pa.int32()), ("part", pa.list_(pa.float64()))])
            x = matrix(batch.column(batch.schema.get_field_index(features)))
            cols = {}
            for name in extra:
                c = batch.column(batch.schema.get_field_index(name))
                cols[name] = matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)
            clients = batch.column(batch.schema.get_field_index(CLIENT)).to_numpy(zero_copy_only=False)
            for client, rows in by_silo(clients):
                v = np.asarray(statistic(client, x[rows], {k: a[rows] for k, a in cols.items()}), dtype=float)
                totals[client] = totals[client] + v if client in totals else v
                if len(totals) * len(v) > FLUSH_VALUES:
                    yield flush()
        if totals:
            yield flush()

    parts = df.select(CLIENT, features, *extra).mapInArrow(partial, f"{CLIENT} {silo_type(df)}, salt int, part array<double>")
    salted = parts.withColumn("part", array_to_vector("part")).groupBy(CLIENT, "salt").agg(
        Summarizer.sum(F.col("part")).alias("part")
    )
    return salted.groupBy(CLIENT).agg(vector_to_array(Summarizer.sum(F.col("part"))).alias("sums"))
