"""Cleaning, one-hot encoding, projections and feature selection on the wide table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from siloml.functions import joins
from siloml.functions.numbering import numbered
from siloml.functions.staging import stage
from siloml.functions.vectors import assemble, quoted
from siloml.spec import CONTRACT, FEATURES, LABEL, ROW_ID, TRAIN

MAX_LEVELS = 2000  # dense columns that one categorical column may make by default

# Columns of the credit-default table.
CREDIT_RENAMES = {"default.payment.next.month": "def_pay", "PAY_0": "PAY_1"}
CREDIT_ID = "ID"
CREDIT_CATEGORICALS = ("SEX", "EDUCATION", "MARRIAGE")
CREDIT_KBEST = ("PAY_1", "PAY_2", "PAY_3", "PAY_4", "PAY_5")


def clean(df: DataFrame, id_column: str, label_column: str, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Rename, turn the table's own id into the stable row key and the target into an integer label."""
    df = df.withColumnsRenamed(dict(renames or {}))
    rest = [c for c in df.columns if c not in (id_column, label_column)]
    return df.select(
        quoted(id_column).cast("bigint").alias(ROW_ID),
        quoted(label_column).cast("int").alias(LABEL),
        *[quoted(c) for c in rest],
    )


def clean_credit(df: DataFrame) -> DataFrame:
    """``clean`` with the credit-default names."""
    return clean(df, CREDIT_ID, "def_pay", CREDIT_RENAMES)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, one pass."""
    wide = df.select([F.count_if(quoted(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "nulls")


def require_no_nulls(df: DataFrame, columns: Sequence[str]) -> None:
    bad = {r["column"]: r["nulls"] for r in null_counts(df, columns).where("nulls > 0").collect()}
    if bad:
        raise ValueError(f"null values in feature columns: {bad}")


def category_levels(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted level set of each categorical column over the whole table, found in one pass.

    The distinct (column, level) pairs are combined map-side; only their list reaches the driver, as every
    level becomes a column. A column with more than ``max_levels`` levels is refused.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("level")) for c in columns
    ])).alias("p")
    distinct = stage(df.select(pairs).select("p.*").distinct())
    wide = [r["column"] for r in distinct.groupBy("column").count().where(F.col("count") > max_levels).collect()]
    if wide:
        raise ValueError(f"more than {max_levels} levels in {sorted(wide)}: not categorical, or raise max_levels")
    found = distinct.collect()
    if any(r["level"] is None for r in found):
        raise ValueError(f"null level in {list(columns)}")
    levels: dict[str, list] = {}
    for c in columns:
        names = [r["level"] for r in found if r["column"] == c]
        numeric = isinstance(df.schema[c].dataType, NumericType)
        levels[c] = sorted(names, key=float if numeric else None)
    return levels


def one_hot(df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence] | None = None,
            max_levels: int = MAX_LEVELS) -> DataFrame:
    """Dense 0/1 columns ``<column>_<level>`` for every level, after the untouched columns."""
    levels = levels or category_levels(df, columns, max_levels)
    kept = [quoted(c) for c in df.columns if c not in columns]
    encoded = [
        F.when(quoted(c).cast("string") == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}")
        for c in columns
        for v in levels[c]
    ]
    return df.select(*kept, *encoded)


def level_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level, pos, n): each level of each column, its place in one common space, and its rows; a stored table.

    Places run over the columns as given, then over their levels (numbers by value, other values as text). Levels
    are counted map-side and numbered in sorted ranges: any number of them, and none reaches the driver. A null
    is no level.
    """
    def cell(i: int, c: str) -> Column:
        level = quoted(c).cast("string")
        number = quoted(c).cast("double") if isinstance(df.schema[c].dataType, NumericType) else F.lit(None).cast("double")
        return F.struct(F.lit(i).alias("i"), number.alias("number"), level.alias("level"))

    cells = df.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns)])).alias("c")).select("c.*")
    counted = cells.where("level IS NOT NULL").groupBy("i", "number", "level").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(c) for c in columns])
    return stage(numbered(counted, ["i", "number", "level"], "pos").select(F.get(names, F.col("i")).alias("column"), "level", "pos", "n"))


def _placed(df: DataFrame, column: str, side: DataFrame, size: int) -> DataFrame:
    """``df`` with ``column`` replaced by its level's place: one broadcast inside the byte bound, else a join of what is not hot."""
    keyed = df.withColumn("_level", quoted(column).cast("string"))
    if size <= joins.BROADCAST_BYTES:
        found = keyed.join(F.broadcast(side.drop("n")), "_level", "left")
    else:  # frequent levels, at most rows / HOT_ROWS of them, and nulls do not go through the shuffle
        hot, known = side.where(F.col("n") > joins.HOT_ROWS).drop("n"), keyed.where("_level IS NOT NULL")
        cold = known.join(F.broadcast(hot), "_level", "left_anti").join(side.drop("n"), "_level", "left")
        found = cold.unionByName(known.join(F.broadcast(hot), "_level")).unionByName(
            keyed.where("_level IS NULL").withColumn("_pos", F.lit(None).cast("bigint")))
    place = F.coalesce("_pos", F.lit(-1)).cast("bigint")
    return found.select(*[(place if c == column else quoted(c)).alias(c) for c in df.columns])


def encode_levels(df: DataFrame, columns: Sequence[str], table: DataFrame) -> DataFrame:
    """``columns`` as places of a ``level_table`` (bigint): the sparse form of ``one_hot``, for any number of levels.

    A null, and a level that the table lacks, is -1, which stands for no column at all.
    """
    sizes = {r["column"]: r["size"] for r in table.groupBy("column").agg(F.sum(F.octet_length("level") + 32).alias("size")).collect()}
    for c in columns:
        side = table.where(F.col("column") == c).select(F.col("level").alias("_level"), F.col("pos").alias("_pos"), "n")
        df = _placed(df, c, side, sizes.get(c, 0))
    return df


def with_levels(df: DataFrame, encoded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Append the places of ``columns`` (``encoded``: row_id and them) to the features of rows prepared from numbers."""
    places = encoded.select(ROW_ID, F.array(*[quoted(c).cast("double") for c in columns]).alias("_places"))
    return df.join(places, ROW_ID).withColumn(FEATURES, F.concat(FEATURES, "_places")).drop("_places")


def feature_columns(df: DataFrame, exclude: str | None = None) -> list[str]:
    """All columns but the contract ones and those whose name matches the ``exclude`` pattern."""
    pattern = re.compile(exclude) if exclude else None
    return [c for c in df.columns if c not in CONTRACT and not (pattern and pattern.search(c))]


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed projection to the named features plus the contract columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} do not exist (selection must come before PCA)")
    return df.select(*[c for c in CONTRACT if c in df.columns], *[quoted(c) for c in columns])


def align_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``df`` in the order of ``like``."""
    return df.select(*[quoted(c) for c in like.columns])


def split_xy(df: DataFrame, features: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Contract columns plus one ``features array<double>`` column."""
    features = list(features or feature_columns(df))
    return df.select(*[c for c in CONTRACT if c in df.columns], *keep, assemble(features).alias(FEATURES))


def threshold(probability: str | Column, cut: float = 0.5) -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return (p > F.lit(cut)).cast("int")


def select_kbest(df: DataFrame, k: int, features: Sequence[str] | None = None) -> list[str]:
    """The k features with the largest ANOVA F score against the label on the training rows.

    Class counts, means and variances of every feature come from one grouped pass; ties go to the
    earlier column.
    """
    features = list(features or feature_columns(df))
    rows = df.where(F.col("split") == TRAIN) if "split" in df.columns else df
    stats = rows.groupBy(LABEL).agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(quoted(c)) for c in features]).alias("mean"),
        F.array(*[F.var_pop(quoted(c)) for c in features]).alias("var"),
    )
    # One row per (label, feature); labels may be many, features are the table's columns.
    long = stage(stats.select("n", F.posexplode(F.arrays_zip("mean", "var")).alias("pos", "s")).select(
        "n", "pos", F.col("s.mean").alias("mean"), F.col("s.var").alias("var")))
    grand = long.groupBy("pos").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    parts = long.join(F.broadcast(grand), "pos").groupBy("pos").agg(
        F.sum("n").alias("total"), F.count("*").alias("labels"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"))
    scores = []
    for r in parts.collect():
        within = r["within"] / max(r["total"] - r["labels"], 1)
        score = r["between"] / max(r["labels"] - 1, 1) / within if within > 0 else 0.0
        scores.append((-score, r["pos"], features[r["pos"]]))
    return [name for _, _, name in sorted(scores)[:k]]
