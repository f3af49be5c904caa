"""Local fits, local evaluations, rounds of fit -> merge -> evaluate, repeated runs."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from siloml.functions.joins import group_count
from siloml.functions.staging import discard, settle, stage, stage_at, staging_dir
from siloml.operators import merge as M
from siloml.operators.metrics import accuracy, classification_report, log_loss
from siloml.operators.params import rebuild_params
from siloml.plans.prepare import Prepared, stack_runs, transform_chain
from siloml.spec import CLIENT, LABEL, SPLIT, TEST, TRAIN, VAL, PrepareSpec, RoundSpec
from siloml.training import boost as B
from siloml.training import forest as FO
from siloml.training import iterate as I
from siloml.training import linear as L
from siloml.training import networks as N

METRIC_SCHEMA = f"round int, {CLIENT} int, class string, metric string, value double"
FACT_SCHEMA = f"round int, {CLIENT} int, n_examples bigint, f1 double, status string"


def local_report(scored: DataFrame, split: str, round_no: int, extra: str | None = None) -> DataFrame:
    """Report of one split per silo as metric rows; ``extra`` names an added accuracy row."""
    rows = scored.where(F.col(SPLIT) == split)
    report = classification_report(rows).select(CLIENT, "class", "metric", "value")
    if extra:
        added = accuracy(rows).select(CLIENT, F.lit("").alias("class"), F.lit(extra).alias("metric"),
                                      F.col("accuracy").alias("value"))
        report = report.unionByName(added)
    return report.select(F.lit(round_no).alias("round"), CLIENT, "class", "metric", "value")


def fit_metrics(scored: DataFrame, round_no: int) -> DataFrame:
    """What a local fit reports: the validation report and the training accuracy."""
    train = accuracy(scored.where(F.col(SPLIT) == TRAIN)).select(
        F.lit(round_no).alias("round"), CLIENT, F.lit("").alias("class"),
        F.lit("train_accuracy").alias("metric"), F.col("accuracy").alias("value"))
    return local_report(scored, VAL, round_no).unionByName(train)


def health_status(n: str, bad: str):
    return F.when(F.col(n) == 0, I.NO_ROWS).when(F.col(bad) > 0, I.NON_FINITE).otherwise(I.OK)


def facts_of(prepared: Prepared, metrics: DataFrame, round_no: int) -> DataFrame:
    """(round, client_id, n_examples, f1, status) of a fit: training rows, class-1 validation F1, health of the rows."""
    n = prepared.health.select(CLIENT, F.col("n_train").alias("n_examples"), health_status("n_train", "bad_train").alias("status"))
    f1 = metrics.where("class = '1' and metric = 'f1-score'").select(CLIENT, F.col("value").alias("f1"))
    return n.join(f1, CLIENT, "left").select(
        F.lit(round_no).alias("round"), CLIENT, "n_examples", F.coalesce("f1", F.lit(0.0)).alias("f1"), "status")


def with_fit_status(facts: DataFrame, fits: DataFrame | None) -> DataFrame:
    """Facts whose fit has failed say how (``fits``: client_id, status); silos without a fit keep theirs."""
    if fits is None:
        return facts
    said = fits.select(CLIENT, F.col("status").alias("fit_status"))
    status = F.when(F.col("status") == I.OK, F.coalesce("fit_status", "status")).otherwise(F.col("status"))
    return facts.join(said, CLIENT, "left").withColumn("status", status).drop("fit_status").select(*facts.columns)


def shared_vector(shared: DataFrame) -> np.ndarray:
    """One merged model as a vector."""
    return np.array(rebuild_params(shared, []).first()["vector"])


class Trainer:
    """One model family over a prepared frame: ``fit`` -> parameter rows, ``score`` -> pred and prob.

    ``fits`` (client_id, status) says afterwards which silos' fits have failed, if the family knows.
    """

    def __init__(self, prepared: Prepared, spec):
        self.prepared, self.spec = prepared, spec
        self.fits: DataFrame | None = None

    def fit(self, round_no: int, shared: DataFrame | None, steps: int | None) -> DataFrame:
        raise NotImplementedError

    def score(self, params: DataFrame, shared: bool) -> DataFrame:
        raise NotImplementedError


    @property
    def one_run(self) -> bool:
        return self.prepared.runs is None

    def start(self, shared: DataFrame | None):
        """The merged model to start from: a vector, or one for each silo if the silos belong to several runs."""
        if shared is None:
            return None
        return shared_vector(shared) if self.one_run else rebuild_params(shared, [CLIENT])


class LinearTrainer(Trainer):
    def fit(self, round_no, shared, steps):
        start = self.start(shared)
        table, self.fits = L.fit_linear(
            self.prepared.df, self.spec, self.prepared.width, start, steps, round_no, self.prepared.n_silos, strict=False)
        return table

    def score(self, params, shared):
        return L.predict_linear(self.prepared.df, params, self.prepared.width, self.prepared.n_silos, shared)


class GradientTrainer(Trainer):
    """One gradient step a fit (``steps`` of them if asked), from the shared model or from zero."""

    def fit(self, round_no, shared, steps):
        df, width, n = self.prepared.df, self.prepared.width, self.prepared.n_silos
        params = settle(L.gradient_step(df, width, self.spec.lr, round_no, shared, self.one_run, n))
        for _ in range((steps or 1) - 1):
            params = settle(L.gradient_step(df, width, self.spec.lr, round_no, params, False, n))
        return params

    def score(self, params, shared):
        return L.predict_linear(self.prepared.df, params, self.prepared.width, self.prepared.n_silos, shared)


class MlpTrainer(Trainer):
    def fit(self, round_no, shared, steps):
        start = self.start(shared)
        self.fits = N.fit_mlp(self.prepared.df, self.spec, self.prepared.width, start, steps)
        return N.mlp_table(self.fits, self.prepared.width, self.spec.hidden, round_no)

    def score(self, params, shared):
        p = self.prepared
        return N.predict_mlp(p.df, params, p.width, self.spec.hidden, p.n_silos, shared)


class ForestTrainer(Trainer):
    """Only hyper-parameters are merged; every silo keeps scoring with its own trees."""

    def fit(self, round_no, shared, steps):
        spec = self.spec
        if shared is not None:
            # The silos' hyper-parameters are one setting, so their mean is too, in every run.
            vector = shared_vector(shared) if self.one_run else rebuild_params(shared, [CLIENT]).first()["vector"]
            trees, depth, split, leaf = (int(v) for v in vector)
            spec = replace(spec, n_trees=trees, max_depth=depth, min_samples_split=split, min_samples_leaf=leaf)
        self.trees = FO.fit_forest(self.prepared.df, spec, self.prepared.width, self.prepared.n_silos, round_no)
        return FO.forest_table(self.prepared.df.select(CLIENT).distinct(), spec, round_no)

    def score(self, params, shared):
        return FO.predict_forest(self.prepared.df, self.trees, self.prepared.n_silos)


class BoostTrainer(Trainer):
    """Rows are packed once; every fit and score reads the blocks."""

    def __init__(self, prepared, spec):
        super().__init__(prepared, spec)
        self.edges = stage(B.edge_table(prepared.df, prepared.width, spec.max_bins))
        self.rows = stage(B.packed_rows(prepared.df, spec.base_margin))

    def fit(self, round_no, shared, steps):
        return B.boost(self.prepared.df, self.spec, self.prepared.width, None, shared, round_no, self.edges, shared=self.one_run,
                       packed=self.rows)

    def score(self, params, shared):
        return B.predict_packed(self.rows, params, shared)


TRAINERS: dict[str, Callable[..., Trainer]] = {
    "logistic": LinearTrainer, "squared_hinge": LinearTrainer, "gradient": GradientTrainer, "mlp": MlpTrainer, "forest": ForestTrainer,
    "boost": BoostTrainer,
}


def trainer(prepared: Prepared, spec) -> Trainer:
    return TRAINERS[spec.family](prepared, spec)


@contextlib.contextmanager
def scored_rows(t: Trainer, params: DataFrame, shared: bool) -> Iterator[DataFrame]:
    """The scored rows, stored once for all reports inside the block."""
    spark = t.prepared.df.sparkSession
    path = f"{staging_dir(spark)}/scored-{uuid.uuid4().hex}"
    yield stage_at(t.score(params, shared).select(CLIENT, SPLIT, LABEL, "pred", "prob"), path)
    discard(spark, path)


def local_fit(t: Trainer, round_no: int = 1, shared: DataFrame | None = None, steps: int | None = None):
    """Fit all silos from the shared parameters: (parameters, fit metrics, facts)."""
    params = t.fit(round_no, shared, steps)
    with scored_rows(t, params, False) as scored:
        metrics = settle(fit_metrics(scored, round_no))
    return params, metrics, settle(with_fit_status(facts_of(t.prepared, metrics, round_no), t.fits))


def local_evaluate(t: Trainer, shared: DataFrame, round_no: int = 1, split: str = TEST) -> DataFrame:
    """Evaluate the shared model on each silo: metric rows with test accuracy and loss.

    The loss follows the family: linear models and forests score their hard classes, networks their
    probabilities, boosters add the rounded test log loss under the name AUC.
    """
    with scored_rows(t, shared, t.one_run) as scored:
        report = local_report(scored, split, round_no, None if t.spec.family == "boost" else "test_accuracy")
        test = scored.where(F.col(SPLIT) == TEST)
        if t.spec.family == "boost":
            loss = log_loss(test).select(CLIENT, F.round("log_loss", 4).alias("value"))
            name = "AUC"
        else:
            hard = t.spec.family != "mlp"
            loss = log_loss(test, probability="pred" if hard else "prob").select(CLIENT, F.col("log_loss").alias("value"))
            name = "loss"
        added = loss.select(F.lit(round_no).alias("round"), CLIENT, F.lit("").alias("class"),
                            F.lit(name).alias("metric"), "value")
        return settle(report.unionByName(added))


def evaluation_facts(prepared: Prepared, round_no: int) -> DataFrame:
    """Facts that weight evaluation metrics: test rows per silo."""
    return prepared.health.select(F.lit(round_no).alias("round"), CLIENT, F.col("n_test").alias("n_examples"),
                                  F.lit(0.0).alias("f1"), health_status("n_test", "bad_test").alias("status"))


RUN_ROUNDS = 1000  # a merge's round number is run * RUN_ROUNDS + round


def coded(df: DataFrame, r: int, runs: DataFrame | None) -> DataFrame:
    """Silo rows of round ``r`` with the round number under which their run is merged."""
    if runs is None:
        return df.withColumn("round", F.lit(r))
    return df.join(runs, CLIENT).withColumn("round", F.col("run") * RUN_ROUNDS + r).select(*df.columns)


def to_silos(shared: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Merged rows given to every silo of their run; a single run shares one model."""
    if runs is None:
        return shared
    of = runs.withColumnRenamed(CLIENT, "silo")
    given = shared.withColumn("run", F.floor(F.col("round") / RUN_ROUNDS).cast("int")).join(of, "run")
    return given.withColumn(CLIENT, F.col("silo")).select(*shared.columns)


def run_rounds(
    prepared: Prepared,
    model_spec,
    spec: RoundSpec,
    merge_metrics: Callable[..., DataFrame] | None = None,
    central: Callable[[DataFrame, int], DataFrame] | None = None,
):
    """Rounds of fit -> merge -> evaluate.

    Returns (shared parameters or trees, history (round, class, metric, value), fit metrics). Each round
    hands over silo-level rows only, so the plan does not grow with the rounds. A round with too few usable
    fits leaves the shared model as it is and has no evaluation; without any merged round there is no model,
    which is an error. Rounds that reuse one fit are alike, so they are evaluated once.

    If the silos belong to several runs, all runs go through a round in the same jobs, each merging its own silos;
    the history then has the column run, and shared rows have the round number run * 1000 + round.
    """
    if spec.rounds >= RUN_ROUNDS:
        raise ValueError(f"at most {RUN_ROUNDS - 1} rounds")
    t, runs = trainer(prepared, model_spec), prepared.runs
    rule = M.choose_merge(model_spec.family, spec.merge)
    boosted = model_spec.family == "boost"
    alike = spec.one_shot and not boosted and merge_metrics is None and central is None
    n_facts, n_runs = prepared.n_silos, 1 if runs is None else group_count(runs, ["run"])
    shared: DataFrame | None = None
    fits: tuple | None = None
    history: DataFrame | None = None
    all_fit: DataFrame | None = None
    all_trees: DataFrame | None = None
    all_facts: DataFrame | None = None
    tests = settle(evaluation_facts(prepared, 0).where(F.col("status") == I.OK))
    for r in range(1, 2 if alike else spec.rounds + 1):
        if boosted or not spec.one_shot or fits is None:
            start = to_silos(shared, runs) if shared is not None and (boosted or not spec.one_shot) else None
            steps = None if spec.one_shot or r == 1 else spec.local_steps
            fits = local_fit(t, r, start, steps)
        metrics = fits[1].withColumn("round", F.lit(r))
        params, facts = coded(fits[0], r, runs), coded(fits[2], r, runs)
        usable = settle(M.usable_facts(facts, spec.min_clients, spec.accept_failures, n_rounds=n_runs))
        all_fit = metrics if all_fit is None else all_fit.unionByName(metrics)
        if usable.isEmpty():
            continue
        if boosted:
            all_trees = params if all_trees is None else all_trees.unionByName(params)
            all_facts = usable if all_facts is None else all_facts.unionByName(usable)
            bagged = rule(
                all_trees, all_facts, trees_per_client=spec.trees_per_client, scale_first=spec.scale_first,
                normalise=spec.weight_trees, n_facts=n_facts * r, rounds_a_run=None if runs is None else RUN_ROUNDS,
            )
            if not spec.weight_trees:  # the weight is kept in base_weight only; leaves score as grown
                bagged = M.scale_base_weights(bagged).withColumn("weight", F.lit(1.0))
            bagged = bagged.select("round", CLIENT, "tree_id", "weight", "nodes")
            shared = settle(bagged)
        else:
            merged = rule(params, usable, n_facts=n_facts)
            merged = merged.select("round", F.lit(-1).alias(CLIENT), "layer", "pos",
                                   F.col("value").cast("double").alias("value"))
            shared = settle(merged)  # one model a run
        evaluated = coded(local_evaluate(t, to_silos(shared, runs), r, spec.report_split), r, runs)
        extra = (lambda: central(shared, r)) if central else None
        if merge_metrics is not None:
            merged_metrics = merge_metrics(evaluated, coded(tests, r, runs))
        else:
            merged_metrics = M.merge_eval(evaluated, coded(tests, r, runs), boosted, extra, n_facts)
        merged_metrics = settle(merged_metrics.select("round", "class", "metric", "value"))
        history = merged_metrics if history is None else history.unionByName(merged_metrics)
    if history is None:
        raise ValueError(f"no round had {spec.min_clients} usable fits to merge")
    if alike and spec.rounds > 1:
        later = F.explode(F.sequence(F.lit(0), F.lit(spec.rounds - 1)))
        again = lambda df: df.withColumn("_later", later).withColumn("round", F.col("round") + F.col("_later")).drop("_later")
        history, all_fit = again(history), again(all_fit)
        shared = shared.withColumn("round", F.col("round") + spec.rounds - 1)
    if runs is not None:
        history = history.withColumn("run", F.floor(F.col("round") / RUN_ROUNDS).cast("int")).withColumn(
            "round", F.col("round") % RUN_ROUNDS)
    return shared, history, all_fit


def merge_fit_metrics(prepared: Prepared, fit_rows: DataFrame) -> DataFrame:
    """(round, class, metric, value): the fit metrics of each round weighted by the silos' training rows."""
    n = prepared.health.select(CLIENT, F.col("n_train").alias("n_examples"))
    facts = fit_rows.select("round", CLIENT).distinct().join(n, CLIENT)
    return M.weighted_metrics(fit_rows, facts)


def result_of(history: DataFrame, family: str) -> DataFrame:
    """The run's result: boosters average all rounds, the others report their last round."""
    return M.mean_over_rounds(history) if family == "boost" else M.final_round(history)


def central_baseline(split_rows: DataFrame, model_spec, split: str = TEST, spec: PrepareSpec = PrepareSpec(encode=False)) -> DataFrame:
    """The same trainer on all rows as one silo: metric rows of the split.

    ``split_rows``: encoded and split rows before any silo-wise scaling; they are scaled as one silo here.
    """
    one = transform_chain(split_rows.withColumn(CLIENT, F.lit(0)), spec, 1)
    t = trainer(one, model_spec)
    params = t.fit(1, None, None)
    return local_report(t.score(params, False), split, 1, "test_accuracy").select("class", "metric", "value")


SWEEP_THREADS = 4  # preparations of a sweep whose jobs run side by side


def side_by_side(spark, work: Sequence[Callable[[], object]]) -> list:
    """The results of ``work``, in its order; several are at work at once, so that one's small jobs fill another's gaps.

    After an error nothing more is begun, and the error is raised. Not for fits: they set the session's size of
    Arrow batches for their own jobs.
    """
    with ThreadPoolExecutor(SWEEP_THREADS) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(f)) for f in work]
        try:
            return [b.result() for b in begun]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def sweep(
    make_prepared: Callable[[int], Prepared],
    model_specs: Iterable,
    spec: RoundSpec,
    repeats: int = 10,
    seed: int = 42,
) -> DataFrame:
    """(run_id, algorithm, repeat, seed, class, metric, value) of repeated runs with different seeds.

    The repeats' preparations are at work side by side and stacked into one table, shared by all algorithms, and each
    algorithm trains all repeats in the same jobs.
    """
    runs = [make_prepared(seed + k) for k in range(min(repeats, 1))]
    if repeats > 1:
        runs += side_by_side(runs[0].df.sparkSession, [lambda k=k: make_prepared(seed + k) for k in range(1, repeats)])
    stacked = stack_runs(runs)
    out: DataFrame | None = None
    for model in model_specs:
        _, history, _ = run_rounds(stacked, model, spec)
        value = F.avg("value") if model.family == "boost" else F.max_by("value", "round")
        rows = history.groupBy("run", "class", "metric").agg(value.alias("value")).select(
            F.concat(F.lit(f"{model.family}-"), F.col("run") + 1).alias("run_id"), F.lit(model.family).alias("algorithm"),
            (F.col("run") + 1).alias("repeat"), (F.col("run") + seed).alias("seed"), "class", "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
