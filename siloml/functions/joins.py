"""Joining a per-group table (statistics, cut points, parameters) to the data."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from siloml.functions.staging import settle
from siloml.spec import ROW_ID

HOT_ROWS = 1_000_000  # rows of one key from which the key is joined on its own
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64
MANY_KEYS = 65_536  # rows of a side from which it is repeated for hot keys only


def group_count(df: DataFrame, groups: Sequence[str]) -> int:
    """Number of distinct groups; one narrow, map-side combined pass."""
    return df.select(*groups).distinct().count()


def attach(
    df: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    rows: int,
    row_bytes: int = 256,
    how: str = "inner",
    salt_on: str = ROW_ID,
) -> DataFrame:
    """Equi-join ``df`` with a side that has at most ``rows`` rows of about ``row_bytes``.

    Inside the byte bound the side is broadcast and the data is not shuffled. Beyond it both sides are
    shuffled on (key, salt): the side is repeated per salt, so that a silo with a third of all rows is
    spread over ``SALTS`` tasks. A side of more than ``MANY_KEYS`` rows is repeated only for the keys with more than
    ``HOT_ROWS`` rows of ``df``, which are counted; blocks of rows are not, as their number says little.
    """
    on = list(on)
    if rows * row_bytes <= BROADCAST_BYTES:
        return df.join(F.broadcast(side), on, how)
    salted, salted_side = _salted(df, side, on, rows, salt_on)
    return salted.join(salted_side, [*on, "_salt"], how).drop("_salt")


def _salted(df: DataFrame, side: DataFrame, on: list[str], rows: int, salt_on: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``attach`` with ``_salt``."""
    every, spread = F.sequence(F.lit(0), F.lit(SALTS - 1)), F.pmod(F.xxhash64(salt_on), F.lit(SALTS)).cast("int")
    if rows > MANY_KEYS and salt_on != "block":
        counts = df.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).dropna(subset=on)
        hot = settle(counts.select(*on, F.lit(True).alias("_hot")))
        side = side.join(F.broadcast(hot), on, "left")
        df = df.join(F.broadcast(hot), on, "left")
        unknown = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])  # matches nothing, so it may lie anywhere
        every, spread = F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))), F.when(F.col("_hot") | unknown, spread).otherwise(0)
    salted_side = side.withColumn("_salt", F.explode(every)).drop("_hot")
    salted = df.withColumn("_salt", spread).drop("_hot")
    return salted, salted_side


def join_hot(df: DataFrame, side: DataFrame, on: Sequence[str], rows: int) -> DataFrame:
    """Inner join to a side that is unique in ``on``, when single keys may hold a large share of ``df``.

    ``rows`` bounds the rows of ``df``. Keys with more than ``HOT_ROWS`` rows (at most rows / HOT_ROWS of
    them) are joined by broadcasting their side rows, so they are never shuffled into one task; all others
    take the ordinary join. With fewer rows in total no key can be hot.
    """
    on = list(on)
    if rows <= HOT_ROWS:
        return df.join(side, on)
    hot_keys = df.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).drop("_n")
    hot_side = side.join(F.broadcast(hot_keys), on, "left_semi")
    cold = df.join(F.broadcast(hot_keys), on, "left_anti").join(side, on)
    return cold.unionByName(df.join(F.broadcast(hot_side), on))
