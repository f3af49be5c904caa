"""Silo preparation: encode -> silos -> split -> scale -> resample -> PCA, all silos in one frame."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from siloml.functions.joins import group_count
from siloml.functions.staging import settle, stage
from siloml.operators.frame import one_hot, feature_columns, select_columns, split_xy
from siloml.operators.resample import smote, train_class_counts, undersample
from siloml.operators.scale import pca, standard_scale
from siloml.operators.silos import dirichlet_silos, natural_silos, silo_health, split_70_20_10
from siloml.spec import CLIENT, CONTRACT, FEATURES, LABEL, PrepareSpec, silo_type


@dataclass(frozen=True)
class Prepared:
    """``df``: contract columns + ``features`` (``width`` wide, named by ``names``), staged."""

    df: DataFrame
    names: tuple[str, ...]
    n_silos: int
    runs: DataFrame | None = None  # (client_id, run): the silos of several independent runs in one table

    @property
    def width(self) -> int:
        return len(self.names)

    @functools.cached_property
    def health(self) -> DataFrame:
        """``silo_health`` of the rows, counted once."""
        return settle(silo_health(self.df))

    def clients(self) -> list[int]:
        return [r[0] for r in self.df.select(CLIENT).distinct().orderBy(CLIENT).collect()]


def silo_frame(table: DataFrame, spec: PrepareSpec) -> tuple[DataFrame, int]:
    """Encoded, assigned and split rows of a cleaned table (row_id, label, columns...)."""
    df = one_hot(table, spec.categoricals) if spec.encode and spec.categoricals else table
    if spec.by_column:
        df = natural_silos(df, spec.by_column)
        df = df.drop(spec.by_column) if spec.by_column != CLIENT else df
        n_silos = group_count(df, [CLIENT])
    else:
        df = dirichlet_silos(df, spec.n_silos, spec.alpha, spec.seed, spec.min_silo_size)
        n_silos = spec.n_silos
    return split_70_20_10(df, spec.seed, n_silos), n_silos


def category_pattern(categoricals) -> str | None:
    """Name pattern of the categorical columns and their one-hot columns, which scaling leaves alone."""
    return "|".join(f"^{c}(_|$)" for c in categoricals) if categoricals else None


def transform_chain(df: DataFrame, spec: PrepareSpec, n_silos: int) -> Prepared:
    """Scale -> SMOTE | undersampling -> selection -> PCA on a split frame."""
    if spec.kbest and spec.pca:
        raise ValueError("PCA replaces the columns that the selection names; choose one of them")
    if spec.scale:
        df = standard_scale(df, exclude=category_pattern(spec.categoricals), n_silos=n_silos)
    names = feature_columns(df)
    if spec.undersample:
        df = undersample(df, spec.seed, 2 * n_silos)  # a binary label
    # SMOTE looks at all features for its neighbours, so the selection follows it.
    if spec.smote:
        vectors = stage(split_xy(df, names))
        vectors = smote(vectors, spec.seed, counts=train_class_counts(vectors)).drop("is_synthetic")
        if spec.kbest:
            keep = [names.index(c) for c in spec.kbest]
            vectors = vectors.withColumn(FEATURES, F.array(*[F.get(FEATURES, F.lit(i)) for i in keep]))
            names = list(spec.kbest)
    else:
        if spec.kbest:
            df = select_columns(df, spec.kbest)
            names = list(spec.kbest)
        vectors = split_xy(df, names)
    if spec.pca:
        vectors = stage(vectors)
        vectors = pca(vectors, spec.pca, len(names), n_silos)
        names = [str(i) for i in range(spec.pca)]
    prepared = stage(vectors.select(*CONTRACT, FEATURES))
    if spec.refuse_bad:
        require_numbers(prepared, names)
    return Prepared(prepared, tuple(names), n_silos)


def require_numbers(df: DataFrame, names) -> None:
    """Refuse null and non-finite features: one silent null would turn a silo's model, then all, into NaN."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    bad = df.where(F.exists(FEATURES, odd) | F.col(LABEL).isNull() | F.col(CLIENT).isNull())
    places = bad.select(F.explode(F.filter(F.transform(FEATURES, lambda v, i: F.when(odd(v), i)), lambda i: i.isNotNull())).alias("i"))
    first = bad.limit(1).collect()
    if first:
        found = sorted({names[r["i"]] for r in places.distinct().collect()})
        raise ValueError(f"null or non-finite values in {found or 'the label or silo columns'}")


def prepare(table: DataFrame, spec: PrepareSpec) -> Prepared:
    """The whole preparation of a cleaned table. The joined, split rows are written once and read back
    column-pruned by every later pass."""
    df, n_silos = silo_frame(stage(table), spec)
    return transform_chain(stage(df), spec, n_silos)


def stack_runs(runs: Sequence[Prepared]) -> Prepared:
    """Independent preparations as one table, which one job can train: silo ids become run * stride + id, runs count from 0.

    The runs must have the same columns and silo ids that are not negative.
    """
    if len({r.names for r in runs}) != 1:
        raise ValueError("runs with different columns cannot be stacked")
    seen = [r.df.agg(F.min(CLIENT).alias("low"), F.max(CLIENT).alias("high")).first() for r in runs]
    if min(s.low for s in seen if s.low is not None) < 0:
        raise ValueError("silo ids of stacked runs must not be negative")
    stride = 1 + max(s.high for s in seen if s.high is not None)
    kind = silo_type(runs[0].df) if stride * len(runs) < 1 << 31 else "bigint"
    df = functools.reduce(DataFrame.unionByName, [
        r.df.withColumn(CLIENT, (F.col(CLIENT) + k * stride).cast(kind)) for k, r in enumerate(runs)])
    df = stage(df)
    of = settle(df.select(CLIENT).distinct().select(CLIENT, F.floor(F.col(CLIENT) / stride).cast("int").alias("run")))
    return Prepared(df, runs[0].names, sum(r.n_silos for r in runs), of)
