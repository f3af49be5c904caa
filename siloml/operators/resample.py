"""Rebalancing of the training rows: random undersampling and SMOTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siloml.functions import joins
from siloml.functions.hashing import hash32
from siloml.functions.joins import attach, group_count
from siloml.functions.staging import stage
from siloml.operators.hashrank import hash_cuts, hash_rank, interval_of
from siloml.operators.knn import knn
from siloml.spec import CLIENT, FEATURES, LABEL, ROW_ID, SPLIT, TRAIN, silo_type

DRAW_CHUNK = 65_536


def train_class_counts(df: DataFrame) -> dict[int, dict[int, int]]:
    """{client: {label: training rows}}; silos x labels rows."""
    rows = df.where(F.col(SPLIT) == TRAIN).groupBy(CLIENT, LABEL).agg(F.count("*").alias("n")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r[CLIENT], {})[r[LABEL]] = r["n"]
    return out


def undersample(df: DataFrame, seed: int, n_groups: int | None = None) -> DataFrame:
    """Cut every training class of a silo to the size of its smallest class, without replacement.

    The kept rows are the first in hash order; the cut row per (silo, label) is the only thing joined.
    ``n_groups`` bounds the (silo, label) groups; they are counted if it is not given.
    """
    train = df.where(F.col(SPLIT) == TRAIN)
    n_groups = group_count(train, [CLIENT, LABEL]) if n_groups is None else n_groups

    def positions(sizes: DataFrame) -> DataFrame:
        smallest = sizes.groupBy(CLIENT).agg(F.min("n").alias("pos"))
        return sizes.join(smallest, CLIENT).select(CLIENT, LABEL, "pos")

    cuts = hash_cuts(train, [CLIENT, LABEL], f"{seed}-rus", positions, n_groups, 1)
    placed = attach(df, cuts, [CLIENT, LABEL], n_groups, 128, how="left")
    keep = (F.col(SPLIT) != TRAIN) | (interval_of(f"{seed}-rus", max_cuts=1) == 0)
    return placed.where(keep).select(*[f"`{c}`" for c in df.columns])


def synthetic_draws(spark, needs: list[tuple[int, int, int, int]], seed: int, k: int, kind: str = "int") -> DataFrame:
    """One row per synthetic row: (client_id, label, j, base, nbr_rank, gap).

    ``needs``: (client, label, minority rows m, rows to make). Draws are made in chunks of fixed size so
    that one silo's draws are spread over tasks.
    """
    schema = f"{CLIENT} {kind}, {LABEL} int, m bigint, need bigint"
    table = spark.createDataFrame(needs, schema).where("need > 0")
    starts = table.withColumn("start", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("need") - 1, F.lit(DRAW_CHUNK).cast("bigint"))))
    draws = starts.repartition(CLIENT, LABEL, "start").withColumn("j", F.explode(F.sequence(
        F.col("start"), F.least(F.col("start") + DRAW_CHUNK, F.col("need")) - 1)))
    key = lambda tag: hash32(seed, CLIENT, LABEL, "j", F.lit(tag))
    return draws.select(
        CLIENT, LABEL, "j",
        F.pmod(key("b"), F.col("m")).alias("base"),
        (F.pmod(key("n"), F.least(F.lit(k), F.col("m") - 1)) + 1).cast("int").alias("nbr_rank"),
        (key("g") / F.lit(float(2 ** 32))).alias("gap"),
    )


def smote(
    df: DataFrame, seed: int, k: int = 5, counts: dict | None = None, leaf_rows: int | None = None
) -> DataFrame:
    """Oversample each smaller training class of a silo to its largest class.

    ``df``: contract columns and ``features``. A synthetic row is ``x + gap * (neighbour - x)`` with the
    neighbour one of the k nearest rows of the same silo and class, and gets the row id ``-(j + 1)``,
    unique in its (silo, label). Returns df's columns plus ``is_synthetic``.
    """
    spark = df.sparkSession
    counts = counts or train_class_counts(df)
    needs = []
    for client, by_label in sorted(counts.items()):
        top = max(by_label.values())
        for label, n in sorted(by_label.items()):
            if n < 2 and top > n:
                raise ValueError(f"silo {client}, label {label}: {n} rows are too few to interpolate")
            needs.append((client, label, n, top - n))
    real = df.withColumn("is_synthetic", F.lit(False))
    short = [(c, l) for c, l, _, need in needs if need > 0]
    if not short:
        return real
    labels = sorted({l for _, l in short})
    wanted = spark.createDataFrame(short, f"{CLIENT} {silo_type(df)}, {LABEL} int")
    minority = stage(
        df.where(F.col(SPLIT) == TRAIN).join(wanted, [CLIENT, LABEL]).select(*[
            CLIENT, LABEL, ROW_ID, FEATURES
        ])
    )
    made = None
    for label in labels:
        part = minority.where(F.col(LABEL) == label).drop(LABEL)
        ranked = hash_rank(part, [CLIENT], f"{seed}-smote", out="base", n_groups=len(counts))
        near = knn(part, k, len(counts), **({"leaf_rows": leaf_rows} if leaf_rows else {}))
        draws = synthetic_draws(spark, [n for n in needs if n[1] == label], seed, k, silo_type(df))
        base = ranked.select(CLIENT, "base", ROW_ID, F.col(FEATURES).alias("_x"))
        other = part.select(CLIENT, F.col(ROW_ID).alias("nbr_id"), F.col(FEATURES).alias("_y"))
        n_draws = sum(n[3] for n in needs if n[1] == label)
        paired = (
            draws.join(base, [CLIENT, "base"])
            .join(near.select(CLIENT, ROW_ID, "nbr_rank", "nbr_id"), [CLIENT, ROW_ID, "nbr_rank"])
            .drop(ROW_ID)
        )
        if n_draws > joins.HOT_ROWS:
            paired = stage(paired)
        # Among copies the same few rows are everybody's neighbours.
        rows = (
            joins.join_hot(paired, other, [CLIENT, "nbr_id"], n_draws)
            .select(
                (-F.col("j") - 1).alias(ROW_ID), CLIENT, F.lit(TRAIN).alias(SPLIT), LABEL,
                F.transform(
                    F.arrays_zip("_x", "_y"), lambda p: p["_x"] + F.col("gap") * (p["_y"] - p["_x"])
                ).alias(FEATURES),
                F.lit(True).alias("is_synthetic"),
            )
        )
        made = rows if made is None else made.unionByName(rows)
    return real.unionByName(made)
