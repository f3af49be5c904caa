"""Scores of predictions per silo: reports, losses, AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siloml.functions.staging import stage
from siloml.spec import CLIENT, LABEL

EPS = 2.220446049250313e-16


def confusion(df: DataFrame, keys: Sequence[str] = (CLIENT,), label: str = LABEL, pred: str = "pred") -> DataFrame:
    """(keys..., label, pred, n); the only pass over the rows that the reports need."""
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def pooled(counts: DataFrame, keys: Sequence[str] = (CLIENT,), over: str = CLIENT) -> DataFrame:
    """Add the counts over all silos, under a null ``over`` key."""
    rest = [k for k in keys if k != over]
    total = counts.groupBy(*rest, "label", "pred").agg(F.sum("n").alias("n"))
    return counts.unionByName(total.withColumn(over, F.lit(None).cast(counts.schema[over].dataType)))


# One row per key with its classes and totals, opened into (class, metric, value) rows.
_PER_CLASS = """inline(array(
    struct(label AS c, if(label = pred, n, 0) AS tp, n AS actual, 0L AS said),
    struct(pred AS c, 0L AS tp, 0L AS actual, n AS said)))"""
_SCORES = (
    "if(said = 0, 0D, tp / said) AS p", "if(support = 0, 0D, tp / support) AS r",
    "if(said + support = 0, 0D, 2 * tp / (said + support)) AS f",
)
_TOTALS = (
    "collect_list(struct(string(c) AS c, p, r, f, support)) AS classes", "double(sum(support)) AS n",
    "sum(tp) / sum(support) AS acc", "avg(p) AS mp", "avg(r) AS mr", "avg(f) AS mf",
    "sum(p * support) / sum(support) AS wp", "sum(r * support) / sum(support) AS wr",
    "sum(f * support) / sum(support) AS wf",
)


def _row(cls: str, metric: str, value: str) -> str:
    return f"named_struct('class', {cls}, 'metric', '{metric}', 'value', {value})"


_NAMES = (("precision", "p"), ("recall", "r"), ("f1-score", "f"))
_CLASS_ROWS = ", ".join([*[_row("k.c", m, f"k.{v}") for m, v in _NAMES], _row("k.c", "support", "double(k.support)")])
_TOTAL_ROWS = ", ".join([
    _row("''", "accuracy", "acc"),
    *[_row(f"'{kind} avg'", m, kind[0] + v) for kind in ("macro", "weighted") for m, v in _NAMES],
    *[_row(f"'{kind} avg'", "support", "n") for kind in ("macro", "weighted")],
])
_ROWS = f"inline(concat(flatten(transform(classes, k -> array({_CLASS_ROWS}))), array({_TOTAL_ROWS})))"


def report_from_counts(counts: DataFrame, keys: Sequence[str] = (CLIENT,)) -> DataFrame:
    """Classification report as long rows (keys..., class, metric, value); a zero division gives 0.

    Classes are the values seen as label or prediction. ``accuracy`` has the empty class.
    """
    keys = list(keys)
    sides = counts.selectExpr(*keys, _PER_CLASS)
    per_class = sides.groupBy(*keys, "c").agg(
        F.sum("tp").alias("tp"), F.sum("actual").alias("support"), F.sum("said").alias("said"))
    per_key = per_class.selectExpr("*", *_SCORES).groupBy(*keys).agg(*map(F.expr, _TOTALS))
    return per_key.selectExpr(*keys, _ROWS)


def classification_report(
    df: DataFrame, keys: Sequence[str] = (CLIENT,), label: str = LABEL, pred: str = "pred", with_pooled: bool = False
) -> DataFrame:
    counts = confusion(df, keys, label, pred)
    return report_from_counts(pooled(counts, keys) if with_pooled else counts, keys)


def accuracy(df: DataFrame, keys: Sequence[str] = (CLIENT,), label: str = LABEL, pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def loss_of(label: Column, probability: Column) -> Column:
    """-log of the probability given to the true class, clipped away from 0 and 1."""
    p = F.when(label == 1, probability).otherwise(F.lit(1.0) - probability)
    return -F.ln(F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS)))


def log_loss(df: DataFrame, keys: Sequence[str] = (CLIENT,), label: str = LABEL, probability: str = "prob") -> DataFrame:
    """Mean log loss; with hard 0/1 predictions as ``probability`` it is 36.04 x the error rate."""
    return df.groupBy(*keys).agg(F.avg(loss_of(F.col(label), F.col(probability).cast("double"))).alias("log_loss"))


def eval_set_metric(df: DataFrame, keys: Sequence[str] = (CLIENT,), label: str = LABEL, probability: str = "prob") -> DataFrame:
    """The boosters' evaluation value: log loss to 4 digits, also under its compatible name AUC."""
    loss = log_loss(df, keys, label, probability)
    return loss.select(*keys, F.round("log_loss", 4).alias("test_logloss"), F.round("log_loss", 4).alias("AUC"))


def auc(df: DataFrame, keys: Sequence[str] = (CLIENT,), label: str = LABEL, score: str = "prob") -> DataFrame:
    """Exact area under the ROC curve by rank sums, ties counted half.

    Rows are first collapsed to counts per distinct score. These are dealt into sorted ranges of (silo, score),
    as many as spark.sql.shuffle.partitions says, so a range holds about as many scores as any other, however
    narrow a silo's scores are; range totals give each range's offset, and only a range is ordered in one task.
    """
    keys = list(keys)
    counts = stage(df.groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) != 1).cast("bigint")).alias("neg")
    ))
    bucketed = stage(counts.repartitionByRange(*keys, "_s").withColumn("_b", F.spark_partition_id()))
    totals = bucketed.groupBy(*keys, "_b").agg(F.sum("neg").alias("_neg"))
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.select(*keys, "_b", (F.sum("_neg").over(order) - F.col("_neg")).alias("_below"))
    within = Window.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    running = bucketed.join(offsets, [*keys, "_b"]).withColumn("_run", F.sum("neg").over(within) - F.col("neg"))
    area = F.sum(F.col("pos") * (F.col("_below") + F.col("_run") + F.col("neg") / 2))
    return running.groupBy(*keys).agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), area / (F.sum("pos").cast("double") * F.sum("neg")))
        .alias("auc")
    )


def flat_name(cls: str | Column = "class", metric: str | Column = "metric") -> Column:
    """``<class>_<metric>``, or the bare metric for the empty class."""
    c = F.col(cls) if isinstance(cls, str) else cls
    m = F.col(metric) if isinstance(metric, str) else metric
    return F.when(c == "", m).otherwise(F.concat_ws("_", c, m))


def flatten_metrics(report: DataFrame, keys: Sequence[str] = (CLIENT,)) -> DataFrame:
    return report.select(*keys, flat_name().alias("name"), "value")


def unflatten_metrics(flat: DataFrame, keys: Sequence[str] = (CLIENT,)) -> DataFrame:
    """Split names on every ``_`` into the nesting path; the last part is the metric."""
    parts = F.split("name", "_")
    return flat.select(
        *keys,
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " -> ").alias("path"),
        F.element_at(parts, -1).alias("metric"),
        "value",
    )


def metrics_map(report: DataFrame, keys: Sequence[str] = (CLIENT,)) -> DataFrame:
    """Wide view: one map<flat name, value> per key."""
    return flatten_metrics(report, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metrics")
    )
