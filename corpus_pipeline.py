"""From raw documents to packed training sequences, in five stages of the training-text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again
as the next one's docs. All but the last return the columns of documents. A stage's result must be written before
the next stage is called, which deletes the tables that the stages before it have staged.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siloml.functions.shipping import ship
from siloml.functions.staging import discard, stage, staged_paths
from siloml.llm import linededup, mixing, packing, quality, simhash
from siloml.llm.common import read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SHINGLE_WORDS, RADIUS = 3, 2
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2


_stored: dict[str, list[str]] = {}  # the staged tables of each stage that its written result no longer needs


def _clear(spark: SparkSession, stages: list[str], read_by: DataFrame | None = None) -> None:
    """Delete the staged tables of some stages, but for those that ``read_by`` still reads."""
    files = read_by.inputFiles() if read_by is not None else []
    for name in stages:
        paths = _stored.get(name, [])
        needed = [p for p in paths if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)]
        for path in set(paths).difference(needed):
            discard(spark, path)
        _stored[name] = needed


def _shipped(f: Stage) -> Stage:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        _clear(spark, [name for name in _stored if name != f.__name__], docs)
        with staged_paths() as paths:
            found = f(spark, docs, sf_dir)
        _stored[f.__name__] = _stored.get(f.__name__, []) + paths
        return found

    return run_stage


def _chosen(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents that ``chosen`` names by doc_id and text hash h, with its other columns; a row that repeats counts once.

    Texts are dealt by both keys once, whatever the size: a sort-merge join, so that no side must fit in memory.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id")
    names = [c for c in chosen.columns if c not in ("doc_id", "h")]
    side = chosen.select(key.alias("__doc"), F.col("h").alias("__h"), *[F.col(c).alias(f"__{c}") for c in names])
    keyed = docs.withColumns({"__doc": key, "__h": F.xxhash64("text")})
    if keyed.groupBy("__doc", "__h").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["__doc", "__h"])
    return keyed.join(stage(side).hint("merge"), ["__doc", "__h"])


@_shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rules or the risk-controlled cutoffs reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


@_shipped
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the lines that an earlier line of the corpus matches; documents left without a word go. n_chars follows."""
    cleaned = linededup.dedup_lines(docs).where((F.col("n_lines") > F.col("n_removed")))
    return cleaned.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


@_shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies (nulls last, then by text hash)."""
    found = simhash.near_duplicates(docs, SHINGLE_WORDS, RADIUS)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("least"))
    return _chosen(docs, least.select("least.doc_id", "least.h")).select(*docs.columns)


@_shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources supply their targets; one cut by more than half is left out."""
    narrow = stage(docs.select("doc_id", F.xxhash64("text").alias("h"), "source", mixing.words().alias("size")))
    mixed = mixing.mix(narrow, WEIGHTS, SHARE, EPOCHS)
    taken = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)
    times = mixed.groupBy("doc_id", "h").agg(F.sum(taken).cast("int").alias("times")).where("times > 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__times"))).alias("__copy")
    return _chosen(docs, times).select(*docs.columns, copies).drop("__copy")


@_shipped
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' token ids into sequences of at most 4,096."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

# The last stage encodes with a tokenizer file, which SQL can't; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all stages over the documents of ``sf_dir``. Only the result's table is left behind."""
    docs, written = read(spark, sf_dir, "documents"), None
    for _, f in STAGES:
        found = f(spark, docs, sf_dir)
        with staged_paths() as paths:
            docs = stage(found)
        if written:
            discard(spark, written)
        written = paths[0]
    _clear(spark, list(_stored))
    return docs
