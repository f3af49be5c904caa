"""Queries on fitted silo models that SQL can follow: one network step, root splits, statuses, many small silos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siloml.functions.joins import group_count
from siloml.functions.staging import settle, stage
from siloml.functions.vectors import sigmoid
from siloml.operators import frame, hashrank, merge as M, silos
from siloml.plans import prepare as prep, rounds as R
from siloml.sources import tables
from siloml.spec import (
    CLIENT, FEATURES, LABEL, ROW_ID, SPLIT, TRAIN, ForestSpec, GradientSpec, LogisticSpec, MlpSpec, PrepareSpec, RoundSpec,
)
from siloml.training import boost as B, forest as FO, linear as L, networks as N, sparse as S

SEED, LR = 42, 0.1
NUMS = tables.RISK_NUMERIC

# The start of the network that takes one step, and the cut points of the two stumps' features.
HIDDEN = 3
START = [((i * 7) % 11 - 5) / 20 for i in range(N.n_weights(len(NUMS), HIDDEN))]
EDGES = [b / 4 for b in range(-8, 9)]
BROKEN = 2  # the silo that gets a NaN


def numeric_silos(spark: SparkSession, d: str, silo: str) -> DataFrame:
    """Split rows with the numeric columns and a natural silo key."""
    table = frame.clean(tables.risk_table(spark, d), "o_orderkey", "many_lines")
    rows = stage(silos.natural_silos(table, silo).select(ROW_ID, F.col(CLIENT).cast("int").alias(CLIENT), LABEL, *NUMS))
    return stage(silos.split_70_20_10(rows, SEED, group_count(rows, [CLIENT])))


def scaled_silos(spark: SparkSession, d: str, silo: str = "n_regionkey") -> prep.Prepared:
    rows = numeric_silos(spark, d, silo)
    return prep.transform_chain(rows, PrepareSpec(encode=False, refuse_bad=False), group_count(rows, [CLIENT]))


def mlp_step(spark, d):
    """(client_id, pos, value): every silo's network of three hidden units after one gradient step from a fixed start."""
    p = scaled_silos(spark, d)
    fits = N.descend_mlp(p.df, MlpSpec(hidden=HIDDEN), p.width, START, LR)
    return fits.select(CLIENT, F.posexplode("vector").alias("pos", "v")).select(CLIENT, "pos", F.round("v", 6).alias("value"))


def forest_roots(spark, d):
    """The root splits of two trees of each silo, over fixed cut points, and the positives on both sides."""
    p = scaled_silos(spark, d)
    cuts = F.array(*[F.array(*[F.lit(e) for e in EDGES]) for _ in NUMS])
    edges = p.df.select(CLIENT).distinct().select(CLIENT, cuts.alias("edges"))
    spec = ForestSpec(n_trees=2, max_depth=1, max_bins=len(EDGES) + 1)
    trees = FO.fit_forest(p.df, spec, p.width, p.n_silos, edges=edges)
    node = lambda i: F.get("nodes", F.lit(i))
    return trees.select(
        CLIENT, F.col("tree_id").cast("int").alias("tree_id"), node(0)["feature"].alias("feature"), node(0)["threshold"].alias("threshold"),
        F.round(node(0)["base_weight"], 6).alias("root"), F.round(node(1)["leaf"], 6).alias("below"), F.round(node(2)["leaf"], 6).alias("above"))


def forest_trees(spark, d):
    """Number, least and greatest depth of the trees of the full forest, and whether all node shares are probabilities."""
    p = scaled_silos(spark, d)
    trees = FO.fit_forest(p.df, ForestSpec(), p.width, p.n_silos)
    sound = F.forall("nodes", lambda n: (n["base_weight"] >= 0) & (n["base_weight"] <= 1) & ((n["feature"] >= 0) == (n["left"] > 0)))
    return trees.groupBy(CLIENT).agg(F.count("*").alias("n_trees"), F.bool_and(sound).alias("sound"), F.bool_and(
        F.size("nodes") > 1).alias("split"))


def broken(spark, d) -> prep.Prepared:
    """The regions, one of which has a NaN in its first training row."""
    p = scaled_silos(spark, d)
    at = p.df.where((F.col(CLIENT) == BROKEN) & (F.col(SPLIT) == TRAIN)).agg(F.min(ROW_ID)).first()[0]
    nan = F.transform(FEATURES, lambda v, i: F.when(i == 0, F.lit(float("nan"))).otherwise(v))
    df = p.df.withColumn(FEATURES, F.when(F.col(ROW_ID) == at, nan).otherwise(F.col(FEATURES)))
    return prep.Prepared(stage(df), p.names, p.n_silos)


def fit_statuses(spark, d):
    """What each silo's logistic fit says, one silo being broken."""
    _, _, facts = R.local_fit(R.trainer(broken(spark, d), LogisticSpec()))
    return facts.select(CLIENT, "n_examples", "status")


def rounds_without_broken(spark, d):
    """The model merged in one round of a gradient step, the broken silo left out."""
    shared, _, _ = R.run_rounds(broken(spark, d), GradientSpec(LR), RoundSpec(rounds=1))
    return shared.select("layer", "pos", F.round("value", 6).alias("value"))


def customer_fits(spark, d):
    """(client_id, status, optimal): a logistic fit for every customer with orders, and whether it meets its condition.

    The gradient is summed by plain column arithmetic, apart from the trainer's kernels. A customer whose orders all
    fall outside the training rows has no fit.
    """
    p = scaled_silos(spark, d, "o_custkey")
    spec = LogisticSpec(C=1.0, tol=1e-7)
    params, fits = L.fit_linear(p.df, spec, p.width, n_silos=p.n_silos, strict=False)
    rows = L.linear_margin(p.df.where(F.col(SPLIT) == TRAIN), params, p.width, p.n_silos, keep_vector=True)
    slope = sigmoid(F.col("margin")) - F.col(LABEL)
    x = lambda i: F.get(FEATURES, F.lit(i)) if i < p.width else F.lit(1.0)
    sums = rows.groupBy(CLIENT).agg(F.first("vector").alias("w"), F.count("*").alias("n"), F.array(
        *[F.sum(slope * x(i)) * spec.C for i in range(p.width + 1)]).alias("g"))
    gap = lambda z: F.when(z["w"] == 0, F.greatest(F.abs(z["g"]) - 1.0, F.lit(0.0))).otherwise(F.abs(z["g"] + F.signum(z["w"])))
    met = F.forall(F.arrays_zip("w", "g"), lambda z: gap(z) <= 1e-5 * F.greatest(F.lit(1.0), F.col("n")))
    return fits.select(CLIENT, "status").join(sums.select(CLIENT, met.alias("optimal")), CLIENT, "left")


def boost_two(spark, d):
    """Two trees of depth 1 for each silo over fixed cut points: splits and leaves, the second on the first one's margin."""
    p = scaled_silos(spark, d)
    edges = p.df.select(CLIENT).distinct().select(CLIENT, F.array(*[F.array(*[F.lit(e) for e in EDGES]) for _ in NUMS]).alias("edges"))
    trees = B.boost(p.df, B.BoostSpec(n_local_trees=2, max_depth=1), p.width, p.clients(), edges=edges)
    node = lambda i: F.get("nodes", F.lit(i))
    return trees.select(
        CLIENT, F.col("tree_id").cast("int").alias("tree_id"), node(0)["feature"].alias("feature"), node(0)["threshold"].alias("threshold"),
        F.round(node(1)["leaf"], 6).alias("below"), F.round(node(2)["leaf"], 6).alias("above"))


def boost_onward(spark, d):
    """The second round's stump of each silo, grown on the bagged stumps of all silos' first round."""
    p = scaled_silos(spark, d)
    edges = p.df.select(CLIENT).distinct().select(CLIENT, F.array(*[F.array(*[F.lit(e) for e in EDGES]) for _ in NUMS]).alias("edges"))
    spec = B.BoostSpec(n_local_trees=1, max_depth=1)
    first = B.boost(p.df, spec, p.width, edges=edges)
    shared = M.bag_trees(first, R.evaluation_facts(p, 1), n_facts=p.n_silos).withColumn("weight", F.lit(1.0))
    trees = B.boost(p.df, spec, p.width, None, shared, 2, edges)
    node = lambda i: F.get("nodes", F.lit(i))
    return trees.select("round", CLIENT, node(0)["feature"].alias("feature"), node(0)["threshold"].alias("threshold"),
                        F.round(node(1)["leaf"], 6).alias("below"), F.round(node(2)["leaf"], 6).alias("above"))


def mlp_learns(spark, d):
    """(client_id, better): whether each silo's network of full size is right more often than the commoner label."""
    p = scaled_silos(spark, d)
    spec = MlpSpec()
    fits = N.fit_mlp(p.df, spec, p.width)
    scored = N.predict_mlp(p.df.where(F.col(SPLIT) == TRAIN), N.mlp_table(fits, p.width, spec.hidden, 1), p.width, spec.hidden, p.n_silos)
    share = F.avg(LABEL)
    return scored.groupBy(CLIENT).agg(
        (F.avg((F.col("pred") == F.col(LABEL)).cast("double")) > F.greatest(share, 1 - share)).alias("better"))


LEVELS = ("o_custkey", "o_orderpriority")


def ordered_by(spark: SparkSession, d: str) -> DataFrame:
    """Customer and priority of each order, by row id."""
    return stage(frame.clean(tables.risk_table(spark, d), "o_orderkey", "many_lines").select(ROW_ID, *LEVELS))


def level_table(spark, d):
    """(column, level, pos, n): every customer and every priority, and its place among all levels."""
    return frame.level_table(ordered_by(spark, d), LEVELS)


def encode_levels(spark, d):
    """Each order's customer and priority as places among all levels."""
    rows = ordered_by(spark, d)
    return frame.encode_levels(rows, LEVELS, frame.level_table(rows, LEVELS))


def optimal_sparse(spark, d):
    """(client_id, pos, optimal): whether each coefficient of fits over numbers, customers and priorities is optimal.

    Margins and the loss's gradient are summed over (row, column) cells by joins, apart from the trainer's kernels.
    """
    p, rows, spec = scaled_silos(spark, d), ordered_by(spark, d), LogisticSpec(C=0.5)
    levels = frame.level_table(rows, LEVELS)
    numbers, n_levels = p.width, levels.count()
    df = stage(frame.with_levels(p.df, frame.encode_levels(rows, LEVELS, levels), LEVELS))
    params = stage(S.fit_sparse(df, spec, numbers, n_levels)[0])
    weights = params.select(CLIENT, F.when(F.col("layer") == 1, numbers + n_levels).otherwise(F.col("pos")).alias("pos"), F.col("value").alias("w"))
    cell = lambda pos, x: F.struct(F.lit(pos).cast("int").alias("pos"), F.lit(x).cast("double").alias("x"))
    cells = [cell(i, F.get(FEATURES, F.lit(i))) for i in range(numbers)] + [cell(numbers + n_levels, 1.0)] + [
        cell(F.get(FEATURES, F.lit(numbers + k)) + numbers, 1.0) for k in range(len(LEVELS))]
    train = stage(df.where(F.col(SPLIT) == TRAIN).select(ROW_ID, CLIENT, LABEL, F.explode(F.array(*cells)).alias("c")).select(
        ROW_ID, CLIENT, LABEL, "c.*"))
    slopes = train.join(weights, [CLIENT, "pos"]).groupBy(ROW_ID).agg(
        (sigmoid(F.sum(F.col("w") * F.col("x"))) - F.first(LABEL)).alias("slope"))
    sums = train.join(slopes, ROW_ID).groupBy(CLIENT, "pos").agg(F.sum(F.col("slope") * F.col("x") * spec.C).alias("g"))
    counts = settle(df.where(F.col(SPLIT) == TRAIN).groupBy(CLIENT).agg(F.count("*").alias("n")))
    each = weights.join(sums, [CLIENT, "pos"], "left").join(F.broadcast(counts), CLIENT)
    w, g = F.col("w"), F.coalesce("g", F.lit(0.0))
    gap = F.when(w == 0, F.greatest(F.abs(g) - 1.0, F.lit(0.0))).otherwise(F.abs(g + F.signum(w)))
    return each.select(CLIENT, "pos", (gap <= 1e-5 * F.greatest(F.lit(1.0), spec.C * F.col("n"))).alias("optimal"))


def hash_rank_fine(spark, d):
    """Ranks of all orders of a status, from 16 buckets that are cut again where they hold more than 64 orders."""
    df = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias(ROW_ID), "o_orderstatus")
    return hashrank.hash_rank(df, ["o_orderstatus"], SEED, hex_digits=1, bucket_rows=64)


QUERIES = {f.__name__: f for f in (mlp_step, forest_roots, forest_trees, fit_statuses, rounds_without_broken, customer_fits, boost_two, boost_onward,
                                   mlp_learns, level_table, encode_levels, optimal_sparse, hash_rank_fine)}
