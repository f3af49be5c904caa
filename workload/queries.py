"""Every registered query: the library's operators on the driver's tables.

The main input is the risk table (one row per order, label "6 or more lines"), with the region as natural
silo. Queries about merging use customers as silos and regions as rounds, so their parameter and metric
tables grow with the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from siloml.functions.joins import group_count
from siloml.functions.staging import settle, stage, staging_dir
from siloml.functions.vectors import quoted, sigmoid
from siloml.operators import frame, hashrank, knn as K, merge as M, metrics as E, params as P, resample, scale, silos
from siloml.plans import prepare as prep, rounds as R
from siloml.sources import models, results, tables
from siloml.spec import (
    CLIENT, FEATURES, LABEL, ROW_ID, SPLIT, TEST, TRAIN, BoostSpec, ForestSpec, GradientSpec, LogisticSpec,
    MlpSpec, PrepareSpec, RoundSpec, SvcSpec,
)
from siloml.training import boost as B, linear as L

SEED = 42
CATS = tables.RISK_CATEGORICAL
NUMS = tables.RISK_NUMERIC
CHAIN = PrepareSpec(by_column="n_regionkey", categoricals=CATS, refuse_bad=False)
LR = 0.1
SUMS = ("o_totalprice", "c_acctbal", "sum_qty", "sum_price", "ret_qty")


# ---- shared inputs -------------------------------------------------------------------------------

def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return frame.clean(tables.risk_table(spark, d), "o_orderkey", "many_lines")


def regions(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, label, client_id, numerics, categoricals) with the region as silo."""
    return silos.natural_silos(cleaned(spark, d), "n_regionkey").select(ROW_ID, CLIENT, LABEL, *NUMS, *CATS)


def n_regions(spark: SparkSession, d: str) -> int:
    return group_count(spark.read.parquet(f"{d}/nation.parquet"), ["n_regionkey"])


def split_frame(spark: SparkSession, d: str, seed: int = SEED) -> DataFrame:
    # Staged: the three scans behind a split then read a narrow table instead of repeating the joins.
    return silos.split_70_20_10(stage(regions(spark, d)), seed, n_regions(spark, d))


def encoded_split(spark: SparkSession, d: str) -> DataFrame:
    return frame.one_hot(split_frame(spark, d), CATS)


def prepared(spark: SparkSession, d: str, seed: int = SEED) -> prep.Prepared:
    return prep.prepare(cleaned(spark, d).drop("n_nationkey", "o_custkey"), replace(CHAIN, seed=seed))


def lean(spark: SparkSession, d: str, seed: int = SEED) -> prep.Prepared:
    """Scaled numeric features only (7 wide), from the already split table."""
    n = n_regions(spark, d)
    df = split_frame(spark, d, seed).select(ROW_ID, CLIENT, SPLIT, LABEL, *NUMS)
    return prep.transform_chain(stage(df), PrepareSpec(encode=False, refuse_bad=False), n)


def rated(spark: SparkSession, d: str) -> DataFrame:
    """Rule predictions: prob = sigmoid((sum_qty - 130) / 30), pred = prob > 0.5."""
    df = cleaned(spark, d).select(
        ROW_ID, LABEL, "sum_qty", F.col("n_regionkey").alias("region"), F.col("o_custkey").cast("int").alias("customer")
    )
    df = df.withColumn("prob", sigmoid((F.col("sum_qty") - 130.0) / 30.0))
    return df.withColumn("pred", frame.threshold("prob"))


def rated_regions(spark: SparkSession, d: str) -> DataFrame:
    return rated(spark, d).withColumn(CLIENT, F.col("region"))


def customer_facts(spark: SparkSession, d: str) -> DataFrame:
    """(round = region, client_id = customer, n_examples, f1 = share of positives, status)."""
    n = F.count("*")
    return rated(spark, d).groupBy(F.col("region").alias("round"), F.col("customer").alias(CLIENT)).agg(
        n.alias("n_examples"), F.avg(F.col(LABEL).cast("double")).alias("f1"),
        F.when(n % 7 == 0, "FAILED").otherwise("OK").alias("status"),
    )


def customer_params(spark: SparkSession, d: str) -> DataFrame:
    """Parameter rows per customer: layer 0 five mean numerics, layer 1 the mean label."""
    df = cleaned(spark, d)
    means = df.groupBy(F.col("n_regionkey").alias("round"), F.col("o_custkey").cast("int").alias(CLIENT)).agg(
        F.array(*[F.avg(c) for c in SUMS]).alias("w"), F.array(F.avg(F.col(LABEL).cast("double"))).alias("b"),
    )
    return means.select("round", CLIENT, F.posexplode(F.array("w", "b")).alias("layer", "v")).select(
        "round", CLIENT, "layer", F.posexplode("v").alias("pos", "value"))


def customer_metrics(spark: SparkSession, d: str) -> DataFrame:
    """(round, client_id, class, metric, value) reports of the rule predictions per customer."""
    df = rated(spark, d).withColumn("round", F.col("region")).withColumn(CLIENT, F.col("customer"))
    return E.classification_report(df, ["round", CLIENT])


def customer_trees(spark: SparkSession, d: str) -> DataFrame:
    """Two stumps per (round = line number, client = supplier) with line items: split at a mean."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    g = li.groupBy(F.col("l_linenumber").alias("round"), F.col("l_suppkey").cast("int").alias(CLIENT)).agg(
        F.avg("l_quantity").alias("q"), F.count("*").alias("n"),
    )

    def node(i, feature, threshold, left, right, leaf, bw):
        cols = dict(id=F.lit(i), feature=F.lit(feature), threshold=threshold, left=F.lit(left), right=F.lit(right),
                    leaf=leaf, base_weight=bw)
        return F.struct(*[c.alias(k) for k, c in cols.items()])

    zero = F.lit(0.0)
    stump = lambda t: F.array(
        node(0, t, F.col("q") + t, 1, 2, zero, zero + t), node(1, -1, zero, -1, -1, -F.col("q"), zero + 1.0),
        node(2, -1, zero, -1, -1, F.col("q"), zero + 2.0))
    two = F.posexplode(F.array(stump(0), stump(1))).alias("tree_id", "nodes")
    return g.select("round", CLIENT, two).withColumn("weight", F.lit(1.0))


def supplier_facts(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.groupBy(F.col("l_linenumber").alias("round"), F.col("l_suppkey").cast("int").alias(CLIENT)).agg(
        F.count("*").alias("n_examples"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("f1"), F.lit("OK").alias("status"),
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks ---------------------------------------------------------------------------

def scan_table(spark, d):
    schema = StructType([
        StructField("c_custkey", LongType()), StructField("c_nationkey", IntegerType()),
        StructField("c_acctbal", DoubleType()), StructField("c_mktsegment", StringType()),
    ])
    path = fresh_path(spark, "csv")
    spark.read.parquet(f"{d}/customer.parquet").select(*schema.names).write.option("header", True).csv(path)
    return tables.scan_table(spark, path, "csv", schema)


def risk_table(spark, d):
    return rounded(tables.risk_table(spark, d), "sum_price", "avg_disc", "avg_tax")


def silo_load(spark, d):
    """The prepared frame of all silos, summed per (silo, split, label, feature)."""
    p = prepared(spark, d)
    long = p.df.select(CLIENT, SPLIT, LABEL, F.posexplode(FEATURES).alias("pos", "x"))
    return long.groupBy(CLIENT, SPLIT, LABEL, "pos").agg(
        F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


def customer_log(spark, d, flat=False) -> str:
    """A result log with one experiment per customer, written by Spark; returns its path."""
    metrics = customer_metrics(spark, d)
    render = results.render_flat if flat else results.render_report
    path = fresh_path(spark, "log")
    results.write_report_text(render(metrics, ["round", CLIENT]), path)
    return path


def scan_results(spark, d):
    lines = results.scan_lines(results.scan_experiments(spark, customer_log(spark, d)))
    kind = F.when(F.col("line").rlike(results.CLASS_LINE), "class").when(
        F.col("line").rlike(results.METRIC_COMPAT), "metric").when(
        F.contains("line", F.lit(results.HEADER)), "experiment").otherwise("blank")
    return lines.withColumn("kind", kind).where("kind != 'blank'").groupBy("kind").agg(F.count("*").alias("n"))


def write_report(spark, d):
    path = fresh_path(spark, "report")
    rows = customer_metrics(spark, d).withColumn("run_id", F.concat(F.lit("region-"), F.col("round")))
    results.write_report(rows, path)
    back = spark.read.parquet(path)
    return back.groupBy("run_id", "class", "metric").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


def write_read_model(spark, d):
    path = fresh_path(spark, "model")
    table = customer_params(spark, d)
    models.write_model(table, path)
    return rounded(models.read_model(spark, path, P.SCHEMA), "value")


# ---- projections and filters ---------------------------------------------------------------------

def clean(spark, d):
    return cleaned(spark, d).select(ROW_ID, LABEL, "n_regionkey", "o_totalprice", "sum_qty")


def one_hot(spark, d):
    df = frame.one_hot(regions(spark, d).select(ROW_ID, LABEL, "o_totalprice", *CATS), CATS)
    return df


def select_columns(spark, d):
    return frame.select_columns(regions(spark, d), ["sum_qty", "o_totalprice"])


def select_kbest(spark, d):
    best = frame.select_kbest(regions(spark, d), 4, NUMS)
    picked = frame.select_columns(regions(spark, d), best)
    long = picked.unpivot([LABEL], best, "feature", "x")
    return long.groupBy("feature").agg(F.round(F.avg("x"), 4).alias("mean"))


def align_columns(spark, d):
    df = regions(spark, d)
    yes = df.where(f"{LABEL} = 1").select(ROW_ID, "sum_qty", LABEL)
    no = df.where(f"{LABEL} = 0").select(LABEL, ROW_ID, "sum_qty")
    return yes.union(frame.align_columns(no, yes))


def feature_columns(spark, d):
    df = frame.one_hot(regions(spark, d), CATS)
    names = frame.feature_columns(df, exclude="|".join(CATS))
    return df.select(ROW_ID, *[F.round(quoted(c), 6).alias(c) for c in names])


def split_xy(spark, d):
    df = frame.split_xy(frame.one_hot(regions(spark, d), CATS))
    long = df.select(LABEL, F.posexplode(FEATURES).alias("pos", "x"))
    return long.groupBy(LABEL, "pos").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"))


def pick_silo(spark, d):
    return silos.pick_silo(regions(spark, d), 2).select(ROW_ID, CLIENT, LABEL, "o_totalprice")


def threshold(spark, d):
    return rated(spark, d).select(ROW_ID, "pred")


def flatten_metrics(spark, d):
    return rounded(E.flatten_metrics(E.classification_report(rated_regions(spark, d))), "value")


def unflatten_metrics(spark, d):
    flat = E.flatten_metrics(E.classification_report(rated_regions(spark, d)))
    extra = E.accuracy(rated_regions(spark, d)).select(
        CLIENT, F.lit("test_accuracy").alias("name"), F.col("accuracy").alias("value"))
    return rounded(E.unflatten_metrics(flat.unionByName(extra)), "value")


def flatten_params(spark, d):
    vectors = P.rebuild_params(customer_params(spark, d))
    return rounded(P.flatten_params(vectors), "value")


def rebuild_params(spark, d):
    vectors = P.rebuild_params(customer_params(spark, d))
    return vectors.select(
        "round", CLIENT, F.size("vector").alias("width"),
        F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


def shape_params(spark, d):
    """The 6-value customer vectors as a network of 3 inputs, 1 hidden unit and 1 output."""
    flat = P.flatten_params(P.rebuild_params(customer_params(spark, d)))
    return P.shape_params(flat, 3, 1, 1).groupBy("layer", "pos").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("value"))


# ---- silos and splits ----------------------------------------------------------------------------

def hash_rank(spark, d):
    df = regions(spark, d).select(ROW_ID, CLIENT)
    return hashrank.hash_rank(df, [CLIENT], SEED, n_groups=n_regions(spark, d))


DIRICHLET = dict(n_silos=5, alpha=10.0, seed=SEED, min_silo_size=100)


def dirichlet_silos(spark, d):
    df = stage(cleaned(spark, d).select(ROW_ID, LABEL))
    return silos.dirichlet_silos(df, **DIRICHLET)


def split_70_20_10(spark, d):
    return split_frame(spark, d).select(ROW_ID, CLIENT, SPLIT)


def split_sizes(spark, d):
    return silos.split_sizes(split_frame(spark, d))


def class_distribution(spark, d):
    return silos.class_distribution(split_frame(spark, d))


# ---- resampling, scaling, decomposition ----------------------------------------------------------

def undersample(spark, d):
    df = stage(split_frame(spark, d).select(ROW_ID, CLIENT, SPLIT, LABEL))
    return resample.undersample(df, SEED)


def class_weights(spark, d):
    return rounded(silos.class_weights(split_frame(spark, d)), "weight")


def scale_stats(spark, d):
    stats = scale.scale_stats(split_frame(spark, d), NUMS)
    return stats.select(CLIENT, F.posexplode(F.arrays_zip("mean", "sd")).alias("pos", "s")).select(
        CLIENT, "pos", F.round("s.mean", 4).alias("mean"), F.round("s.sd", 4).alias("sd"))


def standard_scale(spark, d):
    df = split_frame(spark, d).select(ROW_ID, CLIENT, SPLIT, LABEL, *NUMS)
    out = scale.standard_scale(df, NUMS, n_silos=n_regions(spark, d))
    return rounded(out, *NUMS)


def scaled_minority(spark, d) -> tuple[DataFrame, int]:
    p = lean(spark, d)
    return p.df, p.n_silos


def knn(spark, d):
    df, n = scaled_minority(spark, d)
    rows = df.where((F.col(SPLIT) == TRAIN) & (F.col(LABEL) == 1)).select(CLIENT, ROW_ID, FEATURES)
    return K.knn(rows, 5, n).select(CLIENT, ROW_ID, "nbr_rank", "nbr_id", F.round("d2", 6).alias("d2"))


def smote(spark, d):
    df, _ = scaled_minority(spark, d)
    made = resample.smote(df, SEED).where("is_synthetic")
    return made.select(CLIENT, ROW_ID, LABEL, *[
        F.round(F.get(FEATURES, F.lit(i)), 5).alias(f"x{i}") for i in range(len(NUMS))])


def smote_counts(spark, d):
    df, _ = scaled_minority(spark, d)
    return resample.smote(df, SEED).groupBy(CLIENT, SPLIT, LABEL).agg(F.count("*").alias("n"))


def covariance(spark, d):
    p = lean(spark, d)
    return rounded(scale.covariance_entries(scale.covariance(p.df, p.width, p.n_silos)), "cov")


def pca(spark, d):
    p = lean(spark, d)
    return scale.pca(p.df, 3, p.width, p.n_silos)


def pca_reconstruction(spark, d):
    """All components of each silo put together again: loading_i * loading_j * variance summed is the covariance."""
    p = lean(spark, d)
    parts = stage(scale.pca_loadings(scale.covariance(p.df, p.width, p.n_silos), p.width))
    side = lambda name: parts.select(CLIENT, "component", "variance", F.posexplode("loading").alias(name, f"l{name}"))
    both = side("i").join(side("j").drop("variance"), [CLIENT, "component"]).where("i <= j")
    return both.groupBy(CLIENT, "i", "j").agg(F.round(F.sum(F.col("li") * F.col("lj") * F.col("variance")), 6).alias("cov"))


def pca_uncorrelated(spark, d):
    """(client_id, i, j, ok): the projected training columns have the component variances and no covariance."""
    p = lean(spark, d)
    parts = scale.pca_loadings(scale.covariance(p.df, p.width, p.n_silos), 3).select(CLIENT, F.col("component").alias("i"), "variance")
    scores = scale.pca(p.df, 3, p.width, p.n_silos)
    got = scale.covariance_entries(scale.covariance(stage(scores), 3, p.n_silos))
    want = F.when(F.col("i") == F.col("j"), F.col("variance")).otherwise(0.0)
    return got.join(parts, [CLIENT, "i"]).select(CLIENT, "i", "j", (F.abs(F.col("cov") - want) < 1e-9).alias("ok"))


def pca_variance(spark, d):
    """Total variance per silo as the sum of all component variances."""
    p = lean(spark, d)
    parts = scale.pca_loadings(scale.covariance(p.df, p.width, p.n_silos), p.width)
    return parts.groupBy(CLIENT).agg(F.count("*").alias("components"), F.round(F.sum("variance"), 6).alias("variance"))


def embedding_pca_variance(spark, d):
    """The same on the 64-wide embeddings, silo = label, all rows as training rows."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias(ROW_ID), F.col("label").cast("int").alias(CLIENT), F.lit(TRAIN).alias(SPLIT),
        F.lit(0).alias(LABEL), F.col("embedding").cast("array<double>").alias(FEATURES))
    e = stage(e)
    n = group_count(e, [CLIENT])
    parts = scale.pca_loadings(scale.covariance(e, 64, n), 64)
    return parts.groupBy(CLIENT).agg(F.round(F.sum("variance"), 5).alias("variance"))


def transform_chain(spark, d):
    """Scaling, undersampling and selection in a chain, summed per (silo, split, label)."""
    df = stage(split_frame(spark, d).select(ROW_ID, CLIENT, SPLIT, LABEL, *NUMS))
    spec = PrepareSpec(encode=False, undersample=True, kbest=("sum_qty", "ret_qty"))
    p = prep.transform_chain(df, spec, n_regions(spark, d))
    return p.df.groupBy(CLIENT, SPLIT, LABEL).agg(
        F.count("*").alias("n"), F.round(F.sum(F.get(FEATURES, F.lit(0))), 4).alias("sum_qty"),
        F.round(F.sum(F.get(FEATURES, F.lit(1))), 4).alias("ret_qty"))


# ---- training ------------------------------------------------------------------------------------

def init_zero(spark, d):
    return P.init_zero(customer_facts(spark, d), len(NUMS))


def one_step(spark, d):
    p = lean(spark, d)
    return p, L.gradient_step(p.df, p.width, LR)


def gradient_step(spark, d):
    return rounded(one_step(spark, d)[1], "value")


def one_step_merged(spark, d, method: str):
    p, params = one_step(spark, d)
    params = settle(params)
    scored = L.predict_linear(p.df, params, p.width, p.n_silos)
    fits = settle(R.fit_metrics(scored, 1))
    facts = settle(R.facts_of(p, fits, 1))
    return p, settle(M.choose_merge("logistic", method)(params, facts, n_facts=p.n_silos))


def one_step_fedavg(spark, d):
    """Scale -> one gradient step per silo -> FedAvg -> report of the shared model on each silo's test rows."""
    p, shared = one_step_merged(spark, d, "FedAvg")
    scored = L.predict_linear(p.df, shared, p.width, p.n_silos, shared=True).where(F.col(SPLIT) == TEST)
    return rounded(E.classification_report(scored), "value")


def one_step_fedf1(spark, d):
    p, shared = one_step_merged(spark, d, "FedF1")
    scored = L.predict_linear(p.df, shared, p.width, p.n_silos, shared=True).where(F.col(SPLIT) == TEST)
    return rounded(E.classification_report(scored), "value")


def fit_logistic(spark, d):
    p = prepared(spark, d)
    return L.fit_linear(p.df, LogisticSpec(), p.width)[0]


def fit_linear_svc(spark, d):
    p = prepared(spark, d)
    return L.fit_linear(p.df, SvcSpec(), p.width)[0]


def optimal(spark, d, spec):
    """(client_id, pos, optimal): whether each coefficient of the full-width fit meets its optimality condition.

    The gradient of the loss is summed by plain column arithmetic, apart from the trainer's kernels.
    """
    p = prepared(spark, d)
    params, _ = L.fit_linear(p.df, spec, p.width)
    rows = L.linear_margin(p.df.where(F.col(SPLIT) == TRAIN), settle(params), p.width, p.n_silos, keep_vector=True)
    y = F.col(LABEL).cast("double")
    if spec.family == "logistic":
        slope = sigmoid(F.col("margin")) - y
    else:
        s = 2.0 * y - 1.0
        weights = settle(silos.class_weights(p.df).select(CLIENT, LABEL, "weight"))
        rows = rows.join(F.broadcast(weights), [CLIENT, LABEL])
        slope = -2.0 * s * F.greatest(F.lit(0.0), 1.0 - s * F.col("margin")) * F.col("weight")
    x = lambda i: F.get(FEATURES, F.lit(i)) if i < p.width else F.lit(1.0)
    sums = rows.groupBy(CLIENT).agg(
        F.count("*").alias("n"), F.first("vector").alias("w"),
        F.array(*[F.sum(slope * x(i)) * spec.C for i in range(p.width + 1)]).alias("g"))
    each = sums.select(CLIENT, "n", F.posexplode(F.arrays_zip("w", "g")).alias("pos", "c"))
    w, g = F.col("c.w"), F.col("c.g")
    if spec.family == "logistic":  # |g| <= 1, and g = -sign(w) where w is not 0
        gap = F.when(w == 0, F.greatest(F.abs(g) - 1.0, F.lit(0.0))).otherwise(F.abs(g + F.signum(w)))
    else:
        gap = F.abs(g + w)
    return each.select(CLIENT, "pos", (gap <= 1e-5 * F.greatest(F.lit(1.0), spec.C * F.col("n"))).alias("optimal"))


def optimal_logistic(spark, d):
    return optimal(spark, d, LogisticSpec())


def optimal_linear_svc(spark, d):
    return optimal(spark, d, SvcSpec())


THREE_STEPS = RoundSpec(rounds=3, one_shot=False, local_steps=1)


def step_rounds(spark, d, merge: str):
    """Three rounds of gradient step -> merge -> report on each silo, merged by test rows."""
    _, history, _ = R.run_rounds(lean(spark, d), GradientSpec(LR), replace(THREE_STEPS, merge=merge))
    return rounded(history, "value")


def step_rounds_fedavg(spark, d):
    return step_rounds(spark, d, "FedAvg")


def step_rounds_fedf1(spark, d):
    return step_rounds(spark, d, "FedF1")


def step_local_fit(spark, d):
    _, metrics, _ = R.local_fit(R.trainer(lean(spark, d), GradientSpec(LR)))
    return rounded(metrics, "value")


def step_fit_metrics(spark, d):
    """The silos' fit metrics of three rounds, merged by training rows."""
    p = lean(spark, d)
    _, _, fits = R.run_rounds(p, GradientSpec(LR), THREE_STEPS)
    return rounded(R.merge_fit_metrics(p, fits), "value")


def step_local_evaluate(spark, d):
    p = lean(spark, d)
    t = R.trainer(p, GradientSpec(LR))
    params, _, facts = R.local_fit(t)
    shared = settle(M.fedavg(params, facts, p.n_silos))
    return rounded(R.local_evaluate(t, shared), "value")


def step_central_baseline(spark, d):
    rows = split_frame(spark, d).select(ROW_ID, CLIENT, SPLIT, LABEL, *NUMS)
    return rounded(R.central_baseline(rows, GradientSpec(LR)), "value")


def step_sweep(spark, d):
    return rounded(R.sweep(lambda seed: lean(spark, d, seed), [GradientSpec(LR)], THREE_STEPS, repeats=2), "value")


BOOST = BoostSpec()


def fit_report(spark, d, spec):
    """Fit all silos with one family on the full-width table and return what a local fit reports."""
    p = prepared(spark, d)
    _, metrics, _ = R.local_fit(R.trainer(p, spec))
    return metrics


def fit_mlp(spark, d):
    return fit_report(spark, d, MlpSpec())


def fit_forest(spark, d):
    return fit_report(spark, d, ForestSpec())


def boost_first(spark, d):
    p = prepared(spark, d)
    return B.boost(p.df, BOOST, p.width)


def boost_learns(spark, d):
    """(client_id, tree, better): whether every tree of the full booster lowers its silo's training loss."""
    p = prepared(spark, d)
    trees = settle(B.boost(p.df, BOOST, p.width))
    train = p.df.where(F.col(SPLIT) == TRAIN).select(CLIENT, LABEL, FEATURES)
    out = None
    for k in range(BOOST.n_local_trees + 1):
        scored = B.predict_boost(train, trees.where(F.col("tree_id") < k), False)
        loss = E.log_loss(scored).select(CLIENT, F.lit(k).alias("tree"), "log_loss")
        out = loss if out is None else out.unionByName(loss)
    earlier = F.lag("log_loss").over(Window.partitionBy(CLIENT).orderBy("tree"))
    return out.withColumn("better", F.col("log_loss") < earlier).where("tree > 0").select(CLIENT, "tree", "better")


def boost_continue(spark, d):
    p = prepared(spark, d)
    first = B.boost(p.df, BOOST, p.width)
    facts = R.evaluation_facts(p, 1)
    shared = M.bag_trees(first, facts, n_facts=p.n_silos).withColumn("weight", F.lit(1.0))
    return B.boost(p.df, BOOST, p.width, None, shared, round_no=2)


def tree_counts(spark, d):
    """Trees per round in the shared ensemble after ten compatible boosting rounds."""
    trees, _, _ = R.run_rounds(prepared(spark, d), BOOST, RoundSpec())
    return trees.groupBy("round").agg(F.count("*").alias("n_trees"))


def local_fit(spark, d):
    return fit_report(spark, d, LogisticSpec())


def local_evaluate(spark, d):
    p = prepared(spark, d)
    t = R.trainer(p, LogisticSpec())
    params, _, facts = R.local_fit(t)
    return R.local_evaluate(t, M.fedavg(params, facts, p.n_silos).select(
        "round", F.lit(-1).alias(CLIENT), "layer", "pos", "value"))


def central_baseline(spark, d):
    return R.central_baseline(split_frame(spark, d).select(ROW_ID, CLIENT, SPLIT, LABEL, *NUMS), LogisticSpec())


def run_rounds(spark, d):
    _, history, _ = R.run_rounds(prepared(spark, d), SvcSpec(), RoundSpec(one_shot=False))
    return history


def boost_rounds(spark, d):
    _, history, _ = R.run_rounds(prepared(spark, d), BOOST, RoundSpec(merge="FedF1"))
    return history


FAMILIES = (LogisticSpec(), SvcSpec(), MlpSpec(), ForestSpec(), BOOST)


def sweep(spark, d):
    """Ten rounds of five families, ten times over with splits of their own, all repeats of a family in the same jobs."""
    return R.sweep(lambda seed: prepared(spark, d, seed), FAMILIES, RoundSpec(), repeats=10)


# ---- scoring -------------------------------------------------------------------------------------

def predict(spark, d):
    p, params = one_step(spark, d)
    return L.predict_linear(p.df, params, p.width, p.n_silos).select(ROW_ID, CLIENT, "pred")


def predict_proba(spark, d):
    p, params = one_step(spark, d)
    return L.predict_linear(p.df, params, p.width, p.n_silos).select(ROW_ID, CLIENT, F.round("prob", 6).alias("prob"))


def confusion(spark, d):
    return E.confusion(rated_regions(spark, d))


def accuracy(spark, d):
    return rounded(E.accuracy(rated_regions(spark, d)), "accuracy")


def classification_report(spark, d):
    return rounded(E.classification_report(rated_regions(spark, d), with_pooled=True), "value")


def log_loss(spark, d):
    return rounded(E.log_loss(rated_regions(spark, d)), "log_loss")


def log_loss_hard(spark, d):
    return rounded(E.log_loss(rated_regions(spark, d), probability="pred"), "log_loss")


def eval_set_metric(spark, d):
    return E.eval_set_metric(rated_regions(spark, d))


def auc(spark, d):
    return rounded(E.auc(rated_regions(spark, d)), "auc")


# ---- merging -------------------------------------------------------------------------------------

def fedavg(spark, d):
    return rounded(M.fedavg(customer_params(spark, d), customer_facts(spark, d)), "value", digits=4)


def fedf1(spark, d):
    return rounded(M.fedf1(customer_params(spark, d), customer_facts(spark, d)), "value", digits=4)


def choose_merge(spark, d):
    """FedAvg over usable results only: failed silos left out."""
    facts = M.usable_facts(customer_facts(spark, d))
    rule = M.choose_merge("squared_hinge", "FedAvg")
    return rounded(rule(customer_params(spark, d), facts), "value", digits=4)


def skip_empty_or_failed(spark, d):
    return M.usable_facts(customer_facts(spark, d), 2).select("round", CLIENT, "n_examples")


def merge_hyperparams(spark, d):
    """Four hyper-parameters per customer: trees, depth, min split, min leaf from its order count."""
    facts = customer_facts(spark, d)
    n = F.col("n_examples").cast("double")
    values = F.array(100 + n, 5 + n % 6, 2 + n % 4, F.lit(1.0))
    params = facts.select("round", CLIENT, F.lit(0).alias("layer"), F.posexplode(values).alias("pos", "value"))
    return M.choose_merge("forest", "FedAvg")(params, facts)


def bag_trees(spark, d):
    bagged = M.scale_base_weights(M.bag_trees(customer_trees(spark, d), supplier_facts(spark, d)))
    return bagged.select(
        "tree_id", "round", CLIENT, F.size("nodes").alias("n_nodes"), F.round("weight", 6).alias("weight"),
        F.round(F.aggregate("nodes", F.lit(0.0), lambda s, n: s + n["base_weight"]), 6).alias("base_weight"))


def bag_trees_f1(spark, d):
    bagged = M.bag_trees(customer_trees(spark, d), supplier_facts(spark, d), "FedF1", None, scale_first=True)
    return bagged.select("tree_id", "round", CLIENT, F.round("weight", 6).alias("weight"))


def weighted_metrics(spark, d):
    return rounded(M.weighted_metrics(customer_metrics(spark, d), customer_facts(spark, d)), "value")


def mean_metrics(spark, d):
    return rounded(M.mean_metrics(customer_metrics(spark, d)), "value")


def boost_metrics(spark, d):
    """Customer reports plus an AUC row per customer (the rounded log loss)."""
    df = rated(spark, d).withColumn("round", F.col("region")).withColumn(CLIENT, F.col("customer"))
    loss = E.eval_set_metric(df, ["round", CLIENT]).select(
        "round", CLIENT, F.lit("").alias("class"), F.lit("AUC").alias("metric"), F.col("AUC").alias("value"))
    return E.classification_report(df, ["round", CLIENT]).unionByName(loss)


def merge_eval_boost(spark, d):
    return rounded(M.merge_eval_boost(boost_metrics(spark, d), customer_facts(spark, d)), "value")


def merge_eval(spark, d):
    return rounded(M.merge_eval(boost_metrics(spark, d), customer_facts(spark, d), boosted=True), "value")


def region_history(spark, d):
    """(round = region, class, metric, value): merged metrics of the customers of each region."""
    return M.weighted_metrics(customer_metrics(spark, d), customer_facts(spark, d))


def final_round(spark, d):
    return rounded(M.final_round(region_history(spark, d)), "value")


def mean_over_rounds(spark, d):
    return rounded(M.mean_over_rounds(region_history(spark, d)), "value")


# ---- result logs ---------------------------------------------------------------------------------

def parse_results(spark, d):
    parsed = results.parse_results(results.scan_experiments(spark, customer_log(spark, d)))
    return parsed.groupBy("class", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


def parse_results_flat(spark, d):
    blocks = results.scan_experiments(spark, customer_log(spark, d, flat=True))
    return rounded(results.parse_results_flat(blocks), "value")


def average_results(spark, d):
    blocks = results.scan_experiments(spark, customer_log(spark, d))
    return rounded(results.average_results(results.parse_results(blocks), blocks.count()), "value")


def count_results(spark, d):
    counts = results.count_results(spark, customer_log(spark, d))
    return counts.agg(F.sum("experiments").alias("experiments"), F.sum("classes").alias("classes"))


def summary_report(spark, d):
    blocks = results.scan_experiments(spark, customer_log(spark, d))
    parsed, n = results.parse_results(blocks), blocks.count()
    averages = rounded(results.average_results(parsed, n), "value", digits=4)
    return results.summary_report(averages, {"round": 10, "client": 5}, n)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        scan_table, risk_table, silo_load, scan_results, write_report, write_read_model,
        clean, one_hot, select_columns, select_kbest, align_columns, feature_columns, split_xy, pick_silo, threshold,
        flatten_metrics, unflatten_metrics, flatten_params, rebuild_params, shape_params,
        hash_rank, dirichlet_silos, split_70_20_10, split_sizes, class_distribution,
        undersample, class_weights, scale_stats, standard_scale, knn, smote, smote_counts, covariance, pca,
        pca_reconstruction, pca_uncorrelated, pca_variance, embedding_pca_variance, transform_chain,
        init_zero, gradient_step, one_step_fedavg, one_step_fedf1, fit_logistic, fit_linear_svc, optimal_logistic,
        optimal_linear_svc, step_local_fit, step_local_evaluate, step_rounds_fedavg, step_rounds_fedf1,
        step_fit_metrics, step_central_baseline, step_sweep, fit_mlp, fit_forest, boost_first, boost_learns, boost_continue, tree_counts, local_fit, local_evaluate, central_baseline, run_rounds,
        boost_rounds, sweep,
        predict, predict_proba, confusion, accuracy, classification_report, log_loss, log_loss_hard,
        eval_set_metric, auc,
        fedavg, fedf1, choose_merge, skip_empty_or_failed, merge_hyperparams, bag_trees, bag_trees_f1,
        weighted_metrics, mean_metrics, merge_eval_boost, merge_eval, final_round, mean_over_rounds,
        parse_results, parse_results_flat, average_results, count_results, summary_report,
    )
}
