"""Silo assignment, splits and their sizes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from siloml.functions.joins import attach, group_count
from siloml.operators.hashrank import hash_cuts, interval_of
from siloml.spec import CLIENT, FEATURES, LABEL, ROW_ID, SPLIT, TEST, TRAIN, VAL

ATTEMPTS = 10


def label_counts(df: DataFrame, label: str = LABEL) -> dict:
    """Rows of each label value. A draw orders the label values one after the other, so they come to the driver."""
    rows = df.groupBy(label).agg(F.count("*").alias("n")).collect()
    return {r[label]: r["n"] for r in sorted(rows, key=lambda r: r[label])}


def dirichlet_bounds(
    counts: dict, n_silos: int, alpha: float, seed: int, min_silo_size: int, self_balancing: bool = True
) -> dict:
    """Cumulative row counts at which each label's hash order is cut into silos.

    Works on the label counts alone, so another draw after a too small silo costs no data pass.
    """
    rng = np.random.default_rng(seed)
    total = sum(counts.values())
    for _ in range(ATTEMPTS):
        sizes = np.zeros(n_silos, dtype=np.int64)
        bounds = {}
        for value, n in counts.items():
            share = rng.dirichlet([alpha] * n_silos)
            if self_balancing:
                share = np.where(sizes < total / n_silos, share, 0.0)
            share = share / share.sum()
            ends = np.floor(np.cumsum(share) * n).astype(np.int64)
            ends[-1] = n
            bounds[value] = [int(e) for e in ends]
            sizes += np.diff(np.concatenate([[0], ends]))
        if sizes.min() >= min_silo_size:
            return bounds
    raise ValueError(f"no draw in {ATTEMPTS} gives every silo {min_silo_size} of {total} rows; lower the minimum")


def dirichlet_silos(
    df: DataFrame,
    n_silos: int,
    alpha: float = 10.0,
    seed: int = 42,
    min_silo_size: int = 1000,
    label: str = LABEL,
    self_balancing: bool = True,
    counts: dict | None = None,
) -> DataFrame:
    """Label-skewed silos: each label's rows, in hash order, are cut by Dirichlet shares."""
    counts = counts or label_counts(df, label)
    bounds = dirichlet_bounds(counts, n_silos, alpha, seed, min_silo_size, self_balancing)
    schema = StructType([
        StructField(label, df.schema[label].dataType), StructField("ends", ArrayType(LongType())),
    ])
    table = df.sparkSession.createDataFrame([(v, ends[:-1]) for v, ends in bounds.items()], schema)
    cuts = hash_cuts(
        df, [label], f"{seed}-silo", lambda sizes: table.select(label, F.explode("ends").alias("pos")),
        n_groups=len(counts), n_cuts=n_silos - 1,
    )
    placed = attach(df, cuts, [label], len(counts), 64 * n_silos, how="left")
    return placed.withColumn(CLIENT, interval_of(f"{seed}-silo", max_cuts=n_silos - 1)).drop("_cuts")


def natural_silos(df: DataFrame, by_column: str) -> DataFrame:
    """Silos by an integer key of any width that the rows already carry."""
    return df.withColumn(CLIENT, F.col(by_column))


def pick_silo(df: DataFrame, client_id: int) -> DataFrame:
    """Rows of one silo; a directory prune on tables written ``partitionBy(client_id)``."""
    return df.where(F.col(CLIENT) == client_id)


def split_sizes_of(n):
    """(train, test, val) sizes for n rows; also used on columns."""
    temp = F.ceil(F.lit(0.3) * n)
    val = F.ceil(temp * F.lit(1.0 / 3.0))
    return n - temp, temp - val, val


def split_70_20_10(df: DataFrame, seed: int, n_silos: int | None = None, key: str = ROW_ID) -> DataFrame:
    """Exact-size train/test/val labels per silo. Three narrow scans, no shuffle of the rows."""
    n_silos = group_count(df, [CLIENT]) if n_silos is None else n_silos

    def positions(sizes: DataFrame) -> DataFrame:
        train, test, _ = split_sizes_of(F.col("n"))
        return sizes.select(CLIENT, F.explode(F.array(train, train + test)).alias("pos"))

    cuts = hash_cuts(df, [CLIENT], f"{seed}-split", positions, n_silos, 2, key)
    placed = attach(df, cuts, [CLIENT], n_silos, 256, how="left", salt_on=key)
    passed = interval_of(f"{seed}-split", key=key, max_cuts=2)
    name = F.when(passed == 0, TRAIN).when(passed == 1, TEST).otherwise(VAL)
    return placed.withColumn(SPLIT, name).drop("_cuts")


def class_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(CLIENT, SPLIT, LABEL).agg(F.count("*").alias("n"))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(CLIENT, SPLIT).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weights n / (k * n_c) per silo over the training rows."""
    counts = df.where(F.col(SPLIT) == TRAIN).groupBy(CLIENT, LABEL).agg(F.count("*").alias("n"))
    totals = counts.groupBy(CLIENT).agg(F.sum("n").alias("n_all"), F.count("*").alias("k"))
    return counts.join(totals, CLIENT).select(
        CLIENT, LABEL, "n", (F.col("n_all") / (F.col("k") * F.col("n"))).alias("weight")
    )


def silo_health(df: DataFrame) -> DataFrame:
    """(client_id, n_train, n_test, bad_train, bad_test): rows of the silos, and those with null or non-finite values."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    bad = F.exists(FEATURES, odd) | F.col(LABEL).isNull()
    of = lambda split: F.col(SPLIT) == split
    return df.groupBy(CLIENT).agg(
        F.count_if(of(TRAIN)).alias("n_train"), F.count_if(of(TEST)).alias("n_test"),
        F.count_if(of(TRAIN) & bad).alias("bad_train"), F.count_if(of(TEST) & bad).alias("bad_test"))
