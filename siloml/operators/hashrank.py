"""Exact order statistics under a seeded hash, without ordering a group on one task.

Rows are ordered by (md5(seed|key), key) inside a group. The leading hex digits cut each group into even
buckets, so a count per bucket is enough to place a rank. Buckets of more than ``BUCKET_ROWS`` rows are cut again by
as many further digits as their counts ask for, so what a task orders is bounded whatever a group's size (keys must
be unique: rows of one key have one hash and stay together).

* ``hash_rank``  the 0-based rank of each row (one shuffle by (group, bucket)).
* ``hash_cuts``  only the rows at wanted positions; labelling rows against the cuts moves no data at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siloml.functions.hashing import seeded_hex
from siloml.functions.joins import BROADCAST_BYTES, attach, group_count
from siloml.functions.staging import settle, stage
from siloml.spec import ROW_ID

HEX_DIGITS = 3  # 4,096 buckets per group at first
ALL_DIGITS = 32
BUCKET_ROWS = 1 << 18  # rows from which a bucket is cut again
UNROLLED_CUTS = 64


def _deeper(rows: str, digits: int, bucket_rows: int) -> Column:
    """Digits that cut a bucket of so many rows, found at ``digits``, into buckets of about half the bound or less."""
    more = F.ceil(F.log(16.0, F.col(rows) * 2.0 / bucket_rows))
    return F.least(F.lit(ALL_DIGITS), F.lit(digits) + more).cast("int")


def _bucket_counts(keyed: DataFrame, groups: Sequence[str]) -> DataFrame:
    counts = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_cnt"))
    order = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_before", F.sum("_cnt").over(order) - F.col("_cnt"))


def hash_buckets(
    keyed: DataFrame, groups: Sequence[str], hex_digits: int, bucket_rows: int, key: str
) -> tuple[DataFrame, DataFrame, int]:
    """Rows (with ``_h``) by bucket, the buckets' starts (groups..., _bucket, _cnt, _before), and the number of buckets.

    A bucket is a prefix of the hash; no bucket is a prefix of another one, so buckets sort as their rows do.
    """
    keyed = keyed.withColumn("_bucket", F.substring("_h", 1, hex_digits))
    counts = stage(keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_cnt")))
    wide = counts.where(F.col("_cnt") > bucket_rows).select(*groups, "_bucket", _deeper("_cnt", hex_digits, bucket_rows).alias("_digits"))
    n_wide = wide.count()
    order = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    tops = counts.withColumn("_before", F.sum("_cnt").over(order) - F.col("_cnt"))
    if not n_wide:
        return keyed, tops, counts.count()
    keyed = attach(keyed, wide, [*groups, "_bucket"], n_wide, 128, "left", key).withColumnRenamed("_bucket", "_top")
    keyed = keyed.withColumn("_bucket", F.col("_h").substr(F.lit(1), F.coalesce("_digits", F.lit(hex_digits)))).drop("_digits")
    fine = stage(keyed.groupBy(*groups, "_top", "_bucket").agg(F.count("*").alias("_cnt")))
    inner = Window.partitionBy(*groups, "_top").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    within = fine.withColumn("_within", F.sum("_cnt").over(inner) - F.col("_cnt"))
    starts = within.join(tops.select(*groups, F.col("_bucket").alias("_top"), "_before"), [*groups, "_top"]).select(
        *groups, "_bucket", "_cnt", (F.col("_before") + F.col("_within")).alias("_before"))
    return keyed.drop("_top"), starts, fine.count()


def hash_rank(
    df: DataFrame,
    groups: Sequence[str],
    seed: int | str,
    key: str = ROW_ID,
    out: str = "hash_rank",
    n_groups: int | None = None,
    hex_digits: int = HEX_DIGITS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add the exact 0-based rank of each row in its group. ``n_groups`` is not needed any more: buckets are counted."""
    groups = list(groups)
    keyed, starts, n = hash_buckets(df.withColumn("_h", seeded_hex(seed, key)), groups, hex_digits, bucket_rows, key)
    offsets = starts.drop("_cnt")
    if n * 64 <= BROADCAST_BYTES:
        placed = keyed.join(F.broadcast(offsets), [*groups, "_bucket"])
    else:  # shuffles on (group, bucket), a partitioning that the window below needs anyway
        placed = keyed.join(offsets, [*groups, "_bucket"])
    within = Window.partitionBy(*groups, "_bucket").orderBy("_h", key)
    return placed.withColumn(out, F.col("_before") + F.row_number().over(within) - 1).drop("_h", "_bucket", "_before")


def hash_cuts(
    df: DataFrame,
    groups: Sequence[str],
    seed: int | str,
    positions: Callable[[DataFrame], DataFrame],
    n_groups: int,
    n_cuts: int,
    key: str = ROW_ID,
    hex_digits: int = HEX_DIGITS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Rows standing at wanted positions of the hash order, as one sorted array per group.

    ``positions`` maps a table (groups..., n) of group sizes to (groups..., pos): the number of rows that
    stand before each cut, at most ``n_cuts`` per group; a position asked for twice gives two equal cuts
    and one at or past the end gives none. Only the buckets that hold a cut (about cuts/4096 of a group)
    are ordered; the rest of the data is counted and left in place. A bucket of more than ``bucket_rows`` rows
    that holds a cut is counted again by further digits, and only its part with the cut is ordered. Runs as two
    or three jobs on the narrow (groups, key) columns; the cuts are then a local table, not a subplan of everything
    built on them.
    """
    groups = list(groups)
    keyed = df.select(*groups, F.col(key).alias("_key"), seeded_hex(seed, key).alias("_h"))
    keyed = keyed.withColumn("_bucket", F.substring("_h", 1, hex_digits))
    counts = _bucket_counts(keyed.select(*groups, "_bucket"), groups)
    wanted = positions(counts.groupBy(*groups).agg(F.sum("_cnt").alias("n")))
    holders = (
        counts.join(F.broadcast(wanted) if n_groups * n_cuts * 64 <= BROADCAST_BYTES else wanted, groups)
        .where("pos >= _before and pos < _before + _cnt")
        .groupBy(*groups, "_bucket", "_cnt")
        .agg(F.collect_list(F.col("pos") - F.col("_before") + 1).alias("_offsets"))
    )
    holders, n_cut = settle(holders), n_groups * n_cuts
    wide = holders.where(F.col("_cnt") > bucket_rows)
    candidates = attach(keyed, holders.where(F.col("_cnt") <= bucket_rows).drop("_cnt"), [*groups, "_bucket"], n_cut, 128, salt_on="_key")
    if not wide.isEmpty():
        rows = attach(keyed, wide.withColumn("_digits", _deeper("_cnt", hex_digits, bucket_rows)).drop("_cnt"),
                      [*groups, "_bucket"], n_cut, 160, salt_on="_key")
        rows = rows.withColumn("_fine", F.col("_h").substr(F.lit(1), F.col("_digits")))
        fine = rows.groupBy(*groups, "_bucket", "_fine").agg(F.count("*").alias("_cnt"), F.first("_offsets").alias("_offsets"))
        order = Window.partitionBy(*groups, "_bucket").orderBy("_fine").rowsBetween(Window.unboundedPreceding, 0)
        here = fine.withColumn("_end", F.sum("_cnt").over(order)).withColumn("_offsets", F.transform(
            F.filter("_offsets", lambda o: (o > F.col("_end") - F.col("_cnt")) & (o <= F.col("_end"))),
            lambda o: o - (F.col("_end") - F.col("_cnt"))))
        finer = settle(here.where(F.size("_offsets") > 0).select(*groups, F.col("_fine").alias("_bucket"), "_offsets"))
        narrow = rows.select(*groups, "_key", "_h", F.col("_fine").alias("_bucket"))
        candidates = candidates.unionByName(attach(narrow, finer, [*groups, "_bucket"], n_cut, 128, salt_on="_key"))
    within = Window.partitionBy(*groups, "_bucket").orderBy("_h", "_key")
    ranked = candidates.withColumn("_rn", F.row_number().over(within).cast("bigint"))
    picked = ranked.where(F.array_contains("_offsets", F.col("_rn"))).withColumn(
        "_times", F.size(F.filter("_offsets", lambda o: o == F.col("_rn")))
    )
    cuts = picked.groupBy(*groups).agg(
        F.sort_array(F.flatten(F.collect_list(
            F.array_repeat(F.struct("_h", "_key"), F.col("_times"))
        ))).alias("_cuts")
    )
    return settle(cuts)


def interval_of(seed: int | str, cuts: str = "_cuts", key: str = ROW_ID, max_cuts: int | None = None) -> Column:
    """Number of cuts at or before the row: 0 for the first interval; null cuts mean no cut."""
    here = F.struct(seeded_hex(seed, key).alias("_h"), F.col(key).alias("_key"))
    if max_cuts is not None and max_cuts <= UNROLLED_CUTS:
        passed = F.lit(0)
        for i in range(max_cuts):
            passed = passed + F.coalesce((here >= F.get(cuts, F.lit(i))).cast("int"), F.lit(0))
        return passed
    return F.coalesce(F.size(F.filter(cuts, lambda c: c <= here)), F.lit(0))
