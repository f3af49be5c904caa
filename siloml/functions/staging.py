"""Cutting lineage through tables in the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a local master without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="siloml-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as parquet and read it back: survives executor loss, keeps column pruning."""
    return stage_at(df, f"{staging_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}", partition_by)


_noting: list[list[str]] = []


@contextlib.contextmanager
def staged_paths() -> Iterator[list[str]]:
    """The paths of the tables staged inside the block, for a caller that discards them once its result is written."""
    paths: list[str] = []
    _noting.append(paths)
    try:
        yield paths
    finally:
        _noting.pop()


def stage_at(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``stage`` at a given place, for a caller that discards the table itself."""
    for paths in _noting:
        paths.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


SETTLE_ROWS = 10_000


def settle(df: DataFrame) -> DataFrame:
    """End the lineage of a silo-level result.

    A result of at most ``SETTLE_ROWS`` rows, as found, becomes a local relation (later plans stay small and
    are planned fast), a larger one a staged table.
    """
    found = df.limit(SETTLE_ROWS + 1).collect()
    return stage(df) if len(found) > SETTLE_ROWS else df.sparkSession.createDataFrame(found, df.schema)
