"""Per-silo standard scaling and principal components, fitted on the training rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siloml.functions.joins import attach, group_count
from siloml.functions.moments import silo_sums
from siloml.functions.vectors import UNROLL, dot, quoted
from siloml.operators.frame import feature_columns
from siloml.spec import CLIENT, CONTRACT, FEATURES, SPLIT, TRAIN, silo_type

EPS = 2.220446049250313e-16


def scale_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and divisor per silo: arrays in feature order. A constant feature is divided by 1."""
    mean = [F.avg(quoted(c)) for c in features]
    sd = [F.stddev_pop(quoted(c)) for c in features]
    raw = df.where(F.col(SPLIT) == TRAIN).groupBy(CLIENT).agg(
        F.array(*mean).alias("mean"), F.array(*sd).alias("sd")
    )
    constant = lambda m, s: s <= F.lit(10 * EPS) * F.greatest(F.abs(m), F.lit(1.0))
    return raw.select(
        CLIENT, "mean", F.zip_with("mean", "sd", lambda m, s: F.when(constant(m, s), 1.0).otherwise(s)).alias("sd")
    )


def standard_scale(
    df: DataFrame,
    features: Sequence[str] | None = None,
    exclude: str | None = None,
    n_silos: int | None = None,
) -> DataFrame:
    """(x - mean) / population std per silo on all splits; columns outside ``features`` stay as they are."""
    features = list(features or feature_columns(df, exclude))
    n_silos = group_count(df, [CLIENT]) if n_silos is None else n_silos
    stats = scale_stats(df, features).select(CLIENT, F.col("mean").alias("_mean"), F.col("sd").alias("_sd"))
    joined = attach(df, stats, [CLIENT], n_silos, 32 + 16 * len(features), how="left")
    position = {c: i for i, c in enumerate(features)}
    return joined.select([
        ((quoted(c) - F.get("_mean", F.lit(position[c]))) / F.get("_sd", F.lit(position[c]))).alias(c)
        if c in position else quoted(c)
        for c in df.columns
    ])


def _centred_products(client, x, extra):
    d = x.shape[1]
    centred = x - extra["_mean"]
    return np.concatenate([[len(x)], (centred.T @ centred)[np.triu_indices(d)]])


def covariance(df: DataFrame, width: int, n_silos: int | None = None) -> DataFrame:
    """Sample covariance of ``features`` per silo over the training rows.

    Two passes (means, then centred products) avoid cancellation. Tasks sum products of their own rows;
    only silos x d(d+1)/2 partial sums are shuffled. Returns (client_id, n, mean, cov) with ``cov`` the
    upper triangle in row order.
    """
    n_silos = group_count(df, [CLIENT]) if n_silos is None else n_silos
    train = df.where(F.col(SPLIT) == TRAIN)
    means = train.groupBy(CLIENT).agg(
        F.array(*[F.avg(F.get(FEATURES, F.lit(i))) for i in range(width)]).alias("_mean")
    )
    joined = attach(train, means, [CLIENT], n_silos, 8 * width + 64)
    sums = silo_sums(joined.select(CLIENT, FEATURES, "_mean"), _centred_products, ["_mean"])
    return sums.join(means, CLIENT).select(
        CLIENT,
        F.element_at("sums", 1).cast("bigint").alias("n"),
        F.col("_mean").alias("mean"),
        F.transform(
            F.slice("sums", F.lit(2), F.size("sums") - 1),
            lambda v: v / (F.element_at("sums", 1) - 1),
        ).alias("cov"),
    )


def covariance_entries(cov: DataFrame) -> DataFrame:
    """(client_id, i, j, cov) for i <= j."""
    flat = cov.select(CLIENT, F.size("mean").alias("d"), F.posexplode("cov").alias("p", "cov"))
    # Row i of an upper triangle starts at i*d - i(i-1)/2.
    i = F.floor((2 * F.col("d") + 1 - F.sqrt((2 * F.col("d") + 1) ** 2 - 8 * F.col("p"))) / 2).cast("int")
    flat = flat.withColumn("i", i)
    j = F.col("p") - (F.col("i") * F.col("d") - (F.col("i") * (F.col("i") - 1) / 2).cast("int")) + F.col("i")
    return flat.select(CLIENT, "i", j.cast("int").alias("j"), "cov")


def pca_loadings(cov: DataFrame, k: int) -> DataFrame:
    """Top-k eigenvectors per silo from its covariance row; the largest |loading| is made positive."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for client, mean, packed in zip(pdf[CLIENT], pdf["mean"], pdf["cov"]):
                d = len(mean)
                full = np.zeros((d, d))
                full[np.triu_indices(d)] = packed
                full = full + np.triu(full, 1).T
                values, vectors = np.linalg.eigh(full)
                order = np.argsort(-values, kind="stable")[:k]
                for c, o in enumerate(order):
                    v = vectors[:, o]
                    v = v * np.sign(v[np.argmax(np.abs(v))])
                    out.append((client, c, float(values[o]), list(map(float, mean)), list(map(float, v))))
            yield pd.DataFrame(out, columns=[CLIENT, "component", "variance", "mean", "loading"])

    return cov.select(CLIENT, "mean", "cov").mapInPandas(
        solve, f"{CLIENT} {silo_type(cov)}, component int, variance double, mean array<double>, loading array<double>"
    )


def pca(df: DataFrame, k: int, width: int, n_silos: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Replace ``features`` (``width`` wide) by its k centred principal components; all splits, key kept."""
    if k > width:
        raise ValueError(f"{k} components from {width} features")
    n_silos = group_count(df, [CLIENT]) if n_silos is None else n_silos
    packed = (
        pca_loadings(covariance(df, width, n_silos), k)
        .groupBy(CLIENT)
        .agg(
            F.sort_array(F.collect_list(F.struct("component", "loading"))).alias("_c"),
            F.first("mean").alias("_mean"),
        )
        .select(CLIENT, "_mean", F.col("_c.loading").alias("_load"))
    )
    joined = attach(df, packed, [CLIENT], n_silos, 8 * width * (k + 1) + 64, how="left")
    unrolled = width if width * k <= 8 * UNROLL else None
    centred = joined.withColumn("_x", F.zip_with(FEATURES, "_mean", lambda x, m: x - m))
    scores = [dot(F.col("_x"), F.get("_load", F.lit(c)), unrolled) for c in range(k)]
    return centred.select(*[c for c in CONTRACT if c in df.columns], *keep, F.array(*scores).alias(FEATURES))
