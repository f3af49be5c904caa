"""Merging silo models and silo metrics. Parameters are long rows (round, client_id, layer, pos, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siloml.functions.joins import attach, group_count
from siloml.spec import CLIENT

MERGES = ("FedAvg", "FedF1")
ID_BLOCK = 4096  # silo ids per block when trees are numbered


def with_facts(rows: DataFrame, facts: DataFrame, n_facts: int | None, salt_on: str) -> DataFrame:
    """Join silo rows to their facts on (round, client_id).

    With a known number of facts inside the broadcast bound the rows stay where they are. Without one the
    join is left to Spark: a (round, silo) key holds one model's or one report's rows, so it cannot be hot.
    """
    if n_facts is None:
        return rows.join(facts, ["round", CLIENT])
    return attach(rows, facts, ["round", CLIENT], n_facts, 48, salt_on=salt_on)


def usable_facts(
    facts: DataFrame, min_clients: int = 2, accept_failures: bool = True, n_rounds: int | None = None
) -> DataFrame:
    """Facts of the rounds that may be merged.

    Failed silos are left out; a round with fewer than ``min_clients`` results, or with any failure when
    these are not accepted, is dropped whole.
    """
    ok = F.count_if(F.col("status") == "OK")
    bad = F.count_if(F.col("status") != "OK")
    rounds = facts.groupBy("round").agg(ok.alias("_ok"), bad.alias("_bad")).where(F.col("_ok") >= min_clients)
    if not accept_failures:
        rounds = rounds.where("_bad = 0")
    n_rounds = group_count(facts, ["round"]) if n_rounds is None else n_rounds
    return attach(facts.where("status = 'OK'"), rounds.select("round"), ["round"], n_rounds, 16, "left_semi", CLIENT)


def _positive(total: Column) -> Column:
    return F.when(total > 0, total).otherwise(
        F.raise_error(F.lit("all silo weights are zero")).cast("double")
    )


def merge_params(params: DataFrame, facts: DataFrame, weight: str, n_facts: int | None) -> DataFrame:
    """Weighted mean of each position over the silos of a round; partial sums are combined map-side."""
    weights = facts.select("round", CLIENT, F.col(weight).cast("double").alias("_w"))
    joined = with_facts(params, weights, n_facts, "pos")
    total = F.sum("_w")
    return joined.groupBy("round", "layer", "pos").agg(
        (F.sum(F.col("value") * F.col("_w")) / _positive(total)).alias("value")
    )


def fedavg(params: DataFrame, facts: DataFrame, n_facts: int | None = None) -> DataFrame:
    """Silo models weighted by training rows."""
    return merge_params(params, facts, "n_examples", n_facts)


def fedf1(params: DataFrame, facts: DataFrame, n_facts: int | None = None) -> DataFrame:
    """Silo models weighted by the class-1 F1 on validation rows; an absent class counts as 0."""
    return merge_params(params, facts.fillna(0.0, ["f1"]), "f1", n_facts)


def merge_hyperparams(merged: DataFrame, truncate: bool = True) -> DataFrame:
    """Averaged hyper-parameters as integers: cut (compatible) or rounded."""
    value = F.col("value").cast("int") if truncate else F.round("value").cast("int")
    return merged.withColumn("value", value)


def bag_trees(
    trees: DataFrame,
    facts: DataFrame,
    method: str = "FedAvg",
    trees_per_client: int | None = 1,
    scale_first: bool = False,
    normalise: bool = False,
    n_facts: int | None = None,
    rounds_a_run: int | None = None,
) -> DataFrame:
    """Join the silos' trees into one ensemble.

    ``trees`` (round, client_id, tree_id, nodes, ...) holds each silo's new trees. The first silo of the
    first round adds all of its trees, any later (round, silo) its first ``trees_per_client`` (None: all).
    ``weight`` is the silo's merge weight, 1 for the first silo's trees unless ``scale_first``;
    ``normalise`` turns weights into shares of their round's mean. New tree ids run in
    (round, silo, tree) order from 0. With ``rounds_a_run``, a round number holds run * rounds_a_run + round: every run has
    a first silo, and an ensemble of its own in the result.
    """
    name = {"FedAvg": "n_examples", "FedF1": "f1"}[method]
    weights = facts.select("round", CLIENT, F.col(name).cast("double").alias("_w"))
    if normalise:
        mean = weights.groupBy("round").agg(F.avg("_w").alias("_m"))
        weights = attach(weights, mean, ["round"], group_count(facts, ["round"]), 16, salt_on=CLIENT).select("round", CLIENT, (F.col("_w") / _positive(F.col("_m"))).alias("_w"))
    if rounds_a_run:
        run = F.floor(F.col("round") / rounds_a_run)
        first = weights.groupBy(run.alias("_run")).agg(F.min(F.struct("round", CLIENT)).alias("_f")).select("_f.*", F.lit(True).alias("_is_first"))
    else:
        first = weights.orderBy("round", CLIENT).limit(1).select("round", CLIENT, F.lit(True).alias("_is_first"))
    facts_rows = weights.join(F.broadcast(first), ["round", CLIENT], "left").fillna(False, ["_is_first"])
    joined = with_facts(trees.drop("weight"), facts_rows, n_facts, "tree_id")
    order = Window.partitionBy("round", CLIENT).orderBy("tree_id")
    placed = joined.withColumn("_rn", F.row_number().over(order))
    if trees_per_client is not None:
        placed = placed.where(F.col("_is_first") | (F.col("_rn") <= trees_per_client))

    # Ids: trees before the round, before the silo's id block, before the silo in its block, then the place
    # within the silo. A block holds at most ID_BLOCK silos and a round 2^32 / ID_BLOCK blocks, so no
    # ordering runs over all silos.
    def before(counts: DataFrame, within: list[str], order: str, out: str) -> DataFrame:
        upto = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn(out, F.sum("_n").over(upto) - F.col("_n")).drop("_n")

    per_silo = placed.groupBy("round", CLIENT).agg(F.count("*").alias("_n"))
    per_silo = per_silo.withColumn("_block", F.floor(F.col(CLIENT) / ID_BLOCK))
    per_block = per_silo.groupBy("round", "_block").agg(F.sum("_n").alias("_n"))
    per_round = per_block.groupBy("round").agg(F.sum("_n").alias("_n"))
    offsets = before(per_silo, ["round", "_block"], CLIENT, "_in_block").join(
        before(per_block, ["round"], "_block", "_in_round").join(before(per_round, [], "round", "_rounds"), "round"),
        ["round", "_block"],
    ).select("round", CLIENT, (F.col("_in_block") + F.col("_in_round") + F.col("_rounds")).alias("_offset"))
    weight = F.col("_w") if scale_first else F.when(F.col("_is_first"), 1.0).otherwise(F.col("_w"))
    rest = [c for c in trees.columns if c not in ("round", CLIENT, "tree_id", "weight")]
    return placed.join(offsets, ["round", CLIENT]).select(
        (F.col("_offset") + F.col("_rn") - 1).alias("tree_id"), "round", CLIENT,
        weight.alias("weight"), *rest,
    )


def scale_base_weights(bagged: DataFrame) -> DataFrame:
    """Multiply the nodes' ``base_weight`` statistics by the tree weight; leaf values stay."""
    scaled = F.transform(
        "nodes", lambda n: n.withField("base_weight", n["base_weight"] * F.col("weight"))
    )
    return bagged.withColumn("nodes", scaled)


def tree_count(n_local: int, n_clients: int, n_rounds: int, trees_per_client: int = 1) -> int:
    """Ensemble size after ``n_rounds`` with the compatible first-silo rule."""
    return n_local + (n_clients - 1) * trees_per_client + (n_rounds - 1) * n_clients * trees_per_client


def weighted_metrics(metrics: DataFrame, facts: DataFrame, by: Sequence[str] = ("class", "metric"),
                     n_facts: int | None = None) -> DataFrame:
    """Row-weighted mean of each metric over the silos of a round that report it."""
    weights = facts.select("round", CLIENT, F.col("n_examples").cast("double").alias("_w"))
    joined = with_facts(metrics, weights, n_facts, "metric")
    return joined.groupBy("round", *by).agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))


def mean_metrics(metrics: DataFrame, by: Sequence[str] = ("class", "metric")) -> DataFrame:
    return metrics.groupBy(*by).agg(F.avg("value").alias("value"))


def merge_eval_boost(metrics: DataFrame, facts: DataFrame, by: Sequence[str] = ("class", "metric"),
                     n_facts: int | None = None) -> DataFrame:
    """Boosters: AUC weighted by rows, every other metric a plain mean."""
    weights = facts.select("round", CLIENT, F.col("n_examples").cast("double").alias("_w"))
    joined = with_facts(metrics, weights, n_facts, "metric")
    return joined.groupBy("round", *by).agg(
        F.when(F.col("metric") == "AUC", F.sum(F.col("value") * F.col("_w")) / F.sum("_w"))
        .otherwise(F.avg("value")).alias("value")
    )


def merge_eval(metrics: DataFrame, facts: DataFrame, boosted: bool,
               central: Callable[[], DataFrame] | None = None, n_facts: int | None = None) -> DataFrame:
    """Evaluation metrics of a round over all silos; boosters get a fixed loss of 0.

    ``central`` may add the rows (round, class, metric, value) of an evaluation on pooled data.
    """
    if boosted:
        merged = merge_eval_boost(metrics, facts, n_facts=n_facts)
        loss = merged.select("round").distinct().select(
            "round", F.lit("").alias("class"), F.lit("loss").alias("metric"), F.lit(0.0).alias("value"))
        merged = merged.unionByName(loss)
    else:
        merged = weighted_metrics(metrics, facts, n_facts=n_facts)
    return merged if central is None else merged.unionByName(central())


def choose_merge(family: str, method: str) -> Callable[..., DataFrame]:
    """Merge rule of a model family."""
    if method not in MERGES:
        raise ValueError(f"unknown merge method {method!r}; choose one of {MERGES}")
    base = fedavg if method == "FedAvg" else fedf1
    if family == "boost":
        return lambda trees, facts, **options: bag_trees(trees, facts, method, **options)
    if family == "forest":
        return lambda params, facts, truncate=True, **options: merge_hyperparams(base(params, facts, **options), truncate)
    return base


def final_round(history: DataFrame, by: Sequence[str] = ("class", "metric")) -> DataFrame:
    """Each metric's value in its last round."""
    return history.groupBy(*by).agg(F.max_by("value", "round").alias("value"))


def mean_over_rounds(history: DataFrame, by: Sequence[str] = ("class", "metric")) -> DataFrame:
    return history.groupBy(*by).agg(F.avg("value").alias("value"))
