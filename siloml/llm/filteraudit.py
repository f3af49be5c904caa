"""What each filter removes, in every order of the filters: potentials of the removal game over coalitions."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siloml.functions.staging import stage

# The filters and their bounds.
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # per cent of the words
MOST_CAPITALS = 5  # per cent of the code points
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"

MOST_FILTERS = 7  # all orders are listed: 5,040 of seven
PARTS_AT_ONCE = 64
COUNTS = ("n", "good", "toxic")


def text_failures(text: bytes, chars: int) -> int:
    """Bits 0 to 3: which of the filters A to D a text of ``chars`` code points fails."""
    words = text.split()  # of bytes: at 0x20 and 0x09-0x0D
    return ((len(words) < LEAST_WORDS)
            | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
            | (100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * chars) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def document_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed, digest) of documents (doc_id, source, text): failed filters A to D, 128 bits of the text.

    A null text counts as empty, a null source is the part ''. Texts are read once, row by row, and go no further.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars = pc.utf8_length(b.column(2)).to_numpy(zero_copy_only=False)
            texts = [t.as_py() for t in b.column(2).cast(pa.large_binary())]
            failed = [text_failures(t, n) for t, n in zip(texts, chars.tolist())]
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "failed", "digest"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {key}, part string, failed int, digest binary")


def failing_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed, n): the filters A to E that documents fail; ``n`` rows that agree in all are one.

    E is failed by a text that a smaller doc_id also has. Only the text's digest and its least id are exchanged:
    the least id per digest is pre-aggregated, and it is joined on digest *and* id, so that a large group of
    copies is no hot key. A row without an id is never a copy nor another one's first.
    """
    rows = stage(document_failures(docs).groupBy("doc_id", "part", "failed", "digest").agg(F.count("*").alias("n")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    marked = rows.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return marked.select("doc_id", "part", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"), "n")


def cells(failing: DataFrame) -> DataFrame:
    """(part, cells array<struct<failed, n, good, toxic>>): documents of each part by what they fail.

    At most 2^filters cells a part, added up before they are exchanged, so a part with a third of all rows is a few
    partial sums of each task.
    """
    added = failing.groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return added.groupBy("part").agg(F.collect_list(F.struct("failed", *COUNTS)).alias("cells"))


def removed_by(failed: np.ndarray, counts: np.ndarray, n_filters: int) -> np.ndarray:
    """The removal game: what each coalition of filters removes, by coalition number, from counts of cells."""
    coalitions = np.arange(1 << n_filters)
    return ((failed[:, None] & coalitions[None, :]) != 0).T.astype(np.int64) @ counts


def potentials(removed: np.ndarray) -> np.ndarray:
    """Potentials of games, times |S|! so that they are integers: games x coalitions in, the same shape out.

    The potential of a coalition is P(S) = (v(S) + the sum of P(S without i) over its filters i) / |S|; hence
    |S|! P(S) = (|S| - 1)! v(S) + the sum of (|S| - 1)! P(S without i).
    """
    out = np.zeros_like(removed)
    for s in range(1, removed.shape[1]):  # a coalition's number is greater than those of its subsets
        out[:, s] = factorial(s.bit_count() - 1) * removed[:, s]
        for i in range(s.bit_length()):
            if s >> i & 1:
                out[:, s] += out[:, s ^ 1 << i]
    return out


def shapley_sums(removed: np.ndarray) -> np.ndarray:
    """games x filters: what a filter removes, summed over all orders. It is k! (P(all) - P(all without it))."""
    k = removed.shape[1].bit_length() - 1
    p, full = potentials(removed), removed.shape[1] - 1
    return np.stack([p[:, full] - k * p[:, full ^ 1 << i] for i in range(k)], axis=1)


def audit_filters(failing: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every order of the filters applied step by step within each part, from rows (part, failed, n, good, toxic).

    ``failed`` has bit i for filter ``names[i]``; n, good and toxic count a row's documents, those labelled good and
    those labelled toxic. Returns part, filter_order, step and the counts kept, removed, redundant (failing the
    step's filter, removed earlier), unique_fails (failing no other filter), good_lost, toxic_lost, shapley (removed by
    the step's filter, summed over all orders). Steps are differences of coalitions; no order is run over rows.
    Parts are independent, so a task holds some parts' games. No rows give no parts.
    """
    k = len(names)
    if k > MOST_FILTERS:
        raise ValueError(f"{k} filters have too many orders to list; the most is {MOST_FILTERS}")
    orders = list(itertools.permutations(range(k)))
    filters = np.asarray([f for o in orders for f in o])
    before = np.asarray([sum(1 << f for f in o[:i]) for o in orders for i in range(k)])
    after, full = before | 1 << filters, (1 << k) - 1
    labels = ["".join(names[f] for f in o) for o in orders for _ in o]
    steps = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PARTS_AT_ONCE):
                some = batch.iloc[at:at + PARTS_AT_ONCE]
                tables = [np.asarray([[c[f] for f in ("failed", *COUNTS)] for c in part], np.int64) for part in some["cells"]]
                total = np.asarray([t[:, 1].sum() for t in tables])
                games = np.stack([removed_by(t[:, 0], t[:, 1:], k) for t in tables])
                n, good, toxic = games[..., 0], games[..., 1], games[..., 2]
                removed = n[:, after] - n[:, before]
                out = {
                    "kept": total[:, None] - n[:, after], "removed": removed,
                    "redundant": n[:, 1 << filters] - removed, "unique_fails": n[:, [full]] - n[:, full ^ 1 << filters],
                    "good_lost": good[:, after] - good[:, before], "toxic_lost": toxic[:, after] - toxic[:, before],
                    "shapley": shapley_sums(n)[:, filters]}
                yield pd.DataFrame({
                    "part": np.repeat(some["part"].to_numpy(), len(steps)), "filter_order": labels * len(some),
                    "step": np.tile(steps, len(some)), **{c: v.ravel() for c, v in out.items()}})

    longs = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return cells(failing).mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in longs))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit_filters`` of the filters A to E on documents (doc_id, source, text) and labels (doc_id, quality, toxic).

    A document is good (toxic) if any label row of its id says 1; without an id or a label it is neither. Documents
    that repeat count as often as they occur. Parts are the sources; a null source is ''. Extra columns play no part.
    """
    failing = failing_documents(docs)
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    rows = failing.join(said, "doc_id", "left").select(
        "part", "failed", "n", (F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"))
    return audit_filters(rows)
