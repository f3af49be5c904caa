"""Result logs as text: rendering reports, scanning and parsing logs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The layout of a result log and the patterns its readers use.
HEADER = "EXPERIMENT #"
CLASS_LINE = r"^Class [\w\s]+:"
METRIC_COMPAT = r"^(\w[\w-]*)\s*:\s*([\d.]+)"
FLAT_COMPAT = r"^([A-Za-z0-9\s._-]+):\s*([\d.]+)"
NUMBER_SOUND = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
METRIC_SOUND = r"^(\w[\w-]*)\s*:\s*(" + NUMBER_SOUND + ")"
FLAT_SOUND = r"^([A-Za-z0-9\s._-]+):\s*(" + NUMBER_SOUND + ")"
FLAT_GROUPS = (("0.0", "Class 0"), ("1.0", "Class 1"), ("weighted avg", "Class weighted avg"), ("macro avg", "Class macro avg"))


def number_text(value: Column) -> Column:
    """A double as Python prints it: plain from 1e-4 up to 1e16, else with a two-digit exponent."""
    java = value.cast("double").cast("string")
    mantissa = F.regexp_extract(java, r"^-?([\d.]+)E", 1)
    exponent = F.regexp_extract(java, r"E(-?\d+)$", 1).cast("int")
    sign = F.when(value < 0, "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    short = F.regexp_replace(mantissa, r"\.0$", "")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    whole = F.rpad(digits, exponent + 1, "0")
    large = F.concat(
        sign, F.substring(whole, F.lit(1), exponent + 1), F.lit("."),
        F.when(F.length(digits) > exponent + 1, F.substring(digits, exponent + 2, F.length(digits))).otherwise("0"),
    )
    power = F.concat(
        sign, short, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0")
    )
    return (
        F.when(~F.contains(java, F.lit("E")), java)
        .when((exponent < 0) & (exponent >= -4), small)
        .when((exponent > 0) & (exponent < 16), large)
        .otherwise(power)
    )


def render_report(metrics: DataFrame, keys: Sequence[str], class_order: DataFrame | None = None,
                  experiment_number: int = 1) -> DataFrame:
    """(keys..., text): one log block per key from rows (keys..., class, metric, value).

    Classes come in name order with the classless lines in between, where the accuracy line stands in the
    usual report; metrics follow precision, recall, f1-score, support, then name order.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in ("precision", "recall", "f1-score", "support")]),
                                       F.col("metric")), F.lit(0))
    rank = F.when(rank == 0, 99).otherwise(rank)
    line = F.struct(rank.alias("r"), "metric", number_text(F.col("value")).alias("v"))
    blocks = metrics.groupBy(*keys, "class").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    # "0", "1" < accuracy < "macro avg", "weighted avg", "test": digits first, then classless lines.
    place = F.when(F.col("class").rlike(r"^\d"), 0).when(F.col("class") == "", 1).otherwise(2)
    body = F.when(
        F.col("class") == "",
        F.array_join(F.transform("lines", lambda l: F.concat(F.lit("\n"), l["metric"], F.lit(": "), l["v"], F.lit("\n"))), ""),
    ).otherwise(F.concat(
        F.lit("\nClass "), F.col("class"), F.lit(":\n"),
        F.array_join(F.transform("lines", lambda l: F.concat(F.lit("  "), l["metric"], F.lit(": "), l["v"], F.lit("\n"))), ""),
    ))
    placed = blocks.select(*keys, F.struct(place.alias("p"), "class", body.alias("b")).alias("s"))
    header = F.lit(f"\n{HEADER}{experiment_number}:\n")
    return placed.groupBy(*keys).agg(
        F.concat(header, F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["b"]), "")).alias("text")
    )


def render_flat(metrics: DataFrame, keys: Sequence[str], experiment_number: int = 1) -> DataFrame:
    """(keys..., text): a booster's block, one ``name: value`` line per flat metric (class labels as 0.0)."""
    cls = F.when(F.col("class").rlike(r"^\d+$"), F.concat(F.col("class"), F.lit(".0"))).otherwise(F.col("class"))
    name = F.when(cls == "", F.col("metric")).otherwise(F.concat_ws("_", cls, "metric"))
    line = F.concat(F.lit("\n"), name, F.lit(": "), number_text(F.col("value")), F.lit("\n"))
    return metrics.groupBy(*keys).agg(F.concat(
        F.lit(f"\n{HEADER}{experiment_number}:\n"), F.array_join(F.sort_array(F.collect_list(line)), "")
    ).alias("text"))


def write_report(metrics: DataFrame, path: str) -> None:
    """Append metric rows as parquet, one directory per run."""
    metrics.write.mode("append").partitionBy("run_id").parquet(path)


def write_report_text(blocks: DataFrame, path: str) -> None:
    """Append rendered blocks as text files."""
    blocks.select("text").write.mode("append").text(path)


def scan_experiments(spark: SparkSession, paths) -> DataFrame:
    """(file, experiment, block): the text blocks after each ``EXPERIMENT #`` of each log.

    The header is the record separator of a line-splittable text scan, so one huge log is read by many
    tasks. ``experiment`` is unique in its file, not consecutive: the start of the file's part that a task
    reads, and the block's place among the task's.
    """
    raw = spark.read.option("lineSep", HEADER).text(paths)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    blocks = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.concat_ws("-", F.col("_metadata.file_block_start"), place).alias("experiment"),
        F.col("value").alias("block"),
    )
    return blocks.where(F.col("block").rlike(r"^\d+:"))


def scan_lines(blocks: DataFrame) -> DataFrame:
    """(file, experiment, line_no, line) of scanned blocks, in order; the header text opens line 0."""
    lines = blocks.select("file", "experiment", F.posexplode(F.split("block", r"\r?\n")).alias("line_no", "raw"))
    header = F.when(F.col("line_no") == 0, F.concat(F.lit(HEADER), "raw")).otherwise(F.col("raw"))
    return lines.select("file", "experiment", "line_no", F.trim(header).alias("line"))


def parse_results(blocks: DataFrame, compat: bool = True) -> DataFrame:
    """(file, experiment, class, metric, value) of class-style blocks; a repeated metric keeps its last value.

    A metric line belongs to the last ``Class ...:`` line before it; compatible parsing files the bare
    accuracy line under the class before it and cuts numbers at an exponent. The state is carried inside
    one block, so the array fold replaces a window and its shuffle.
    """
    pattern = METRIC_COMPAT if compat else METRIC_SOUND
    lines = F.transform(F.split("block", r"\r?\n"), lambda l: F.trim(l))
    classes = F.filter(
        F.transform(lines, lambda l, i: F.struct(i.alias("i"), l.alias("l"))),
        lambda s: F.regexp_like(s["l"], F.lit(CLASS_LINE)),
    )
    parsed = blocks.select("file", "experiment", lines.alias("lines"), classes.alias("classes"))
    rows = parsed.select("file", "experiment", "classes", F.posexplode("lines").alias("line_no", "line"))
    rows = rows.where(~F.col("line").rlike(CLASS_LINE) & F.col("line").rlike(pattern))
    owner = F.try_element_at(F.filter("classes", lambda s: s["i"] < F.col("line_no")), F.lit(-1))["l"]
    if not compat:  # a classless line stands at the margin, a class's lines are indented
        owner = F.when(F.col("line").startswith("accuracy"), F.lit("")).otherwise(owner)
    found = rows.select(
        "file", "experiment", "line_no", owner.alias("class"),
        F.regexp_extract("line", pattern, 1).alias("metric"),
        F.regexp_extract("line", pattern, 2).cast("double").alias("value"),
    ).where("class is not null")
    return found.groupBy("file", "experiment", "class", "metric").agg(F.max_by("value", "line_no").alias("value"))


def flat_metrics(blocks: DataFrame, compat: bool = True) -> DataFrame:
    """(file, experiment, line_no, name, value) of flat ``name: value`` lines."""
    pattern = FLAT_COMPAT if compat else FLAT_SOUND
    return scan_lines(blocks).where(F.col("line").rlike(pattern)).select(
        "file", "experiment", "line_no",
        F.trim(F.regexp_extract("line", pattern, 1)).alias("name"),
        F.regexp_extract("line", pattern, 2).cast("double").alias("value"),
    )


def parse_results_flat(blocks: DataFrame, compat: bool = True) -> DataFrame:
    """(class, metric, value): mean of each flat metric over all blocks, regrouped by class; AUC left out."""
    means = flat_metrics(blocks, compat).groupBy("name").agg(F.avg("value").alias("value"))
    cls = F.lit("")
    for prefix, group in reversed(FLAT_GROUPS):
        cls = F.when(F.startswith("name", F.lit(prefix)), F.lit(group)).otherwise(cls)
    grouped = cls != ""
    accuracy = F.startswith("name", F.lit("accuracy"))
    tail = F.regexp_extract("name", r"^[^_]*_(.*)$", 1)
    return means.where(~F.startswith("name", F.lit("AUC"))).select(
        F.when(grouped, cls).when(accuracy, "Class test").otherwise("").alias("class"),
        F.when(grouped, tail).when(accuracy, "accuracy").otherwise(F.col("name")).alias("metric"),
        "value",
    )


def average_results(parsed: DataFrame, n_experiments: int) -> DataFrame:
    """Sum over experiments / number of scanned blocks: an experiment without the metric, or any, counts as 0."""
    return parsed.groupBy("class", "metric").agg((F.sum("value") / F.lit(n_experiments)).alias("value"))


def count_results(spark: SparkSession, paths) -> DataFrame:
    """Lines holding ``EXPERIMENT #1:`` and lines holding ``Class 0:``, per log."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.groupBy("file").agg(
        F.count_if(F.contains("value", F.lit("EXPERIMENT #1:"))).alias("experiments"),
        F.count_if(F.contains("value", F.lit("Class 0:"))).alias("classes"),
    )


def summary_report(averages: DataFrame, options: dict, n_experiments: int) -> DataFrame:
    """One row: the averages as a text report and as JSON, together with the run's options."""
    per_class = averages.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("m"))
    text = F.concat(F.col("class"), F.lit("\n"), F.array_join(F.transform(
        "m", lambda s: F.concat(F.lit("  "), s["metric"], F.lit(": "), number_text(s["value"]))), "\n"))
    classes = F.sort_array(F.collect_list(F.struct("class", text.alias("t"), "m")))
    return per_class.agg(classes.alias("c")).select(
        F.array_join(F.transform("c", lambda s: s["t"]), "\n").alias("report"),
        F.to_json(F.map_from_entries(F.transform("c", lambda s: F.struct(s["class"], F.map_from_entries(s["m"]))))).alias("averages"),
    ).select(
        F.lit(n_experiments).alias("n_experiments"), "report", "averages",
        F.lit(json.dumps(options, sort_keys=True, default=str)).alias("options"),
    )
