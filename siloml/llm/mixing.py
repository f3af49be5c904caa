"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from siloml.functions.hashing import seeded_hex
from siloml.functions.staging import stage
from siloml.llm.common import WORD, join_measured, prefix_sums


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> tuple[DataFrame, float]:
    """Targets of the sources (source, size): the source's part of ``share`` of all sizes by its weight.

    Sources take the weights in turn, in code point order, null last. No target exceeds ``epochs`` times its
    source's size; the excess goes to the others by weight until none is above. Returns (source, source_size,
    base: sizes of the sources before it, target) and the sum to be taken.
    """
    ordered = prefix_sums(sizes, [F.col("source").isNull(), F.col("source")], F.col("source_size"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    t = stage(ordered.select(
        "row.source", F.col("size").alias("source_size"), F.col("before").alias("base"),
        cycle[(F.col("index") % len(weights)).cast("int")].alias("weight"),
        (F.col("size") * epochs).alias("most")))
    total = t.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget, level, capped = share * total, -1.0, None
    # Each pass finds the sources whose limit is below their share; the level only rises, so the set only grows.
    while True:
        over = F.col("most") <= F.col("weight") * F.lit(level)
        a = t.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)).alias("m"),
                  F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("w"),
                  F.count(F.when(over, 1)).alias("n")).first()
        if a.n == capped or not a.w:
            break
        capped, level = a.n, (budget - a.m) / a.w
    return t.select("source", "source_size", "base", F.least(
        F.col("most").cast("double"), F.col("weight") * F.lit(level)).alias("target")), budget


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2,
        seed: str = "mix") -> DataFrame:
    """Schedule documents (doc_id, source, size in words, other columns) so that each source supplies its target.

    Documents are shuffled within their source by a seeded hash of doc_id. A document's virtual finish time is
    the words of its source up to its end, earlier rounds over the source included, divided by the source's
    target. All are sorted by finish time and taken until the words reach the budget; the document at the end is
    cut there. So a source's words differ from its target by about a document. Returns the documents with
    source_size, target, taken, row (their number in source order) and first (words taken in the mix before
    them, null if they aren't taken). Sizes must not be null; empty documents take part with no words; rows
    that repeat are documents of their own; an empty table gives no rows.
    """
    sizes = stage(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets, budget = source_targets(sizes, weights, share, epochs)
    order = [F.col("source").isNull(), F.col("source"), seeded_hex(seed, "doc_id"), F.col("doc_id"), F.col("size")]
    queued = prefix_sums(docs, order, F.col("size")).select("row", F.col("row.source").alias("source"), "size", "before", "index")
    targets = stage(targets.withColumnRenamed("source", "of"))
    rows = stage(join_measured(queued, targets, F.col("source").eqNullSafe(F.col("of")), "inner").select(
        "row", "size", "source_size", "target", "index", (F.col("before") - F.col("base") + F.col("size")).alias("upto")))
    rounds = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    finish = F.when(F.col("target") > 0, (F.col("upto") + F.col("epoch") * F.col("source_size")) / F.col("target")).otherwise(0.0)
    served = prefix_sums(
        rounds.select("index", "epoch", "size", finish.alias("finish")),
        [F.col("finish"), F.col("index"), F.col("epoch")], F.col("size"))
    left = F.greatest(F.lit(0), F.lit(int(budget)) - F.col("before"))
    got = served.select(F.col("row.index").alias("index"), F.least("size", left).alias("took"), "before")
    sums = stage(got.groupBy("index").agg(
        F.sum("took").alias("taken"), F.min(F.when(F.col("took") > 0, F.col("before"))).alias("first")))
    return rows.join(sums, "index").select("row.*", "source_size", "target", "taken", F.col("index").alias("row"), "first")
