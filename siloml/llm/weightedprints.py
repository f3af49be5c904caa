"""Document fingerprints by consistent weighted sampling: equal samples are as frequent as weighted sets are alike."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siloml.functions.staging import stage
from siloml.llm.common import parts

SAMPLES = 64
SEED = 13  # of the terms' hashes
TERMS = 16384  # weighted terms that are drawn and weighed together, some 50 MB
TEXTS = 128  # documents that share the draws of their common terms
DIGITS = 4  # hex digits of a sample
EMPTY = "0" * DIGITS  # a text without terms has only these; no sample of a term is 0


def terms(text: str) -> Counter[bytes]:
    """The words of a text (runs of anything but ASCII white space) with their counts."""
    return Counter(text.encode().split())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def draws(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """terms x samples: r and the logarithm of c, both gamma of shape 2, and beta, uniform; by term and sample alone.

    Two 64-bit values give five uniform numbers in (0, 1) of 23 bits, which single precision holds exactly.
    """
    salt = _mixed(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x, y = _mixed(hashes[:, None] ^ salt[:samples]), _mixed(hashes[:, None] ^ salt[samples:])

    def uniform(z):
        bits = z.astype(np.uint32) & np.uint32((1 << 23) - 1)
        return (bits.view(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -23)

    def gamma(z):
        return -np.log(uniform(z) * uniform(z >> np.uint64(23)))

    return gamma(x), np.log(gamma(y)), uniform(x >> np.uint64(46) ^ y >> np.uint64(41))


def signatures(bags: Sequence[Mapping[bytes, int]], samples: int = SAMPLES) -> np.ndarray:
    """bags x samples numbers of 16 bits (zero for an empty bag).

    For a sample, a term of weight w has t = floor(ln w / r + beta), y = exp(r (t - beta)) and a = c / (y exp(r)); the
    term with the least a is the sample, with its t. Two bags take the same (term, t) with the probability of
    their generalised Jaccard similarity: the sum of the lesser weights by the sum of the greater. Bags that share a
    weighted term share its t and a. Terms go through in blocks that keep the least a so far, so memory does not
    grow with a text's words times the samples.
    """
    words = list(set().union(*bags))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    ranks = dict(zip(words, rank.tolist()))
    count = np.asarray([len(b) for b in bags], np.int64)
    ends = np.cumsum(count)
    key = np.fromiter(map(ranks.__getitem__, itertools.chain.from_iterable(bags)), np.int64, count.sum()) << 32
    key += np.fromiter(itertools.chain.from_iterable(b.values() for b in bags), np.int64, len(key))
    distinct, place = np.unique(key, return_inverse=True)
    term_of, weight = distinct >> 32, (distinct & 0xFFFFFFFF).astype(np.float32)

    least = np.full((len(bags), samples), np.inf, np.float32)
    term, level = np.zeros((len(bags), samples), np.uint64), np.zeros((len(bags), samples), np.int64)
    column = np.arange(samples)
    for at in range(0, len(distinct), TERMS):
        some = slice(at, at + TERMS)
        used, of = np.unique(term_of[some], return_inverse=True)
        r, log_c, beta = (v[of] for v in draws(hashes[used], samples))
        t = np.floor(np.log(weight[some])[:, None] / r + beta)
        a = log_c - r * (t - beta + np.float32(1.0))
        for o in np.flatnonzero(count):
            mine = place[ends[o] - count[o]:ends[o]] - at
            if len(distinct) > TERMS:
                mine = mine[(mine >= 0) & (mine < len(a))]
                if not len(mine):
                    continue
            mine.sort()
            best = mine[a[mine].argmin(axis=0)]
            value = a[best, column]
            # Blocks come in the terms' order and argmin takes the first, so equal values go to the lesser term.
            nearer = value < least[o]
            least[o][nearer], term[o][nearer] = value[nearer], hashes[term_of[some][best[nearer]]]
            level[o][nearer] = t[best, column][nearer].astype(np.int64)
    value = _mixed(term ^ _mixed(level.view(np.uint64))) % np.uint64(0xFFFF) + np.uint64(1)
    return np.where(count[:, None] > 0, value, 0).astype(np.uint16)


def as_text(signature: np.ndarray) -> str:
    """Four lowercase hex digits a sample."""
    return signature.astype(">u2").tobytes().hex()


def fingerprints_of(texts: Iterable[str], samples: int = SAMPLES) -> np.ndarray:
    return signatures([terms(t) for t in texts], samples)


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and the fingerprint of every whole text of documents (doc_id, text), row by row; a null text is empty."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                found = fingerprints_of([t or "" for t in some.column(1).to_pylist()], samples)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([as_text(s) for s in found], pa.string())],
                                                 names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, fingerprint string")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints; 1 for two empty texts."""
    equal = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda n, i: n + (
        F.substr(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substr(b, i * DIGITS + 1, F.lit(DIGITS))).cast("int"))
    return equal / F.lit(float(samples))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


_PRINTS = "doc_id {key}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(rows: list[tuple], samples: int) -> tuple[list[tuple], list[np.ndarray]]:
    """Results of consecutive rows (doc_id, text) but the last, which only follows; and the rows' signatures."""
    texts = [t for _, t in rows]
    edits = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
    found = fingerprints_of([*texts, *edits], samples)
    own, edited = found[:len(texts)], found[len(texts):]
    out = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), as_text(s), as_text(x), float((s == x).mean()), float((s == f).mean()))
           for (i, t), e, s, x, f in zip(rows, edits, own, edited, own[1:])]
    return out, own


def compare_with_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of their edited texts, and how alike they are.

    An edited text ends with the head of the next document's text, by descending doc_id (nulls last, ties by the
    text's hash; the first follows the last). Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited (likeness to the edited text) and near_next (to the next document). Texts go
    through one range shuffle by id and each sorted range is read as a stream; only a range's first and last
    document wait, in a stored table, for their neighbours in other ranges. A null text is empty; rows that repeat
    stay rows of their own; a single document follows itself; without rows there are none.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = _PRINTS.format(key=key) + ", part int, place int, text string"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], names=fields.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                rows = [(i, t or "") for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
                if last is None:
                    yield batch([(rows[0][0], *[None] * 6, part, 1, rows[0][1])])
                else:
                    rows = [last, *rows]
                last = rows[-1]
                done, _ = _pairs(rows, samples)
                if done:
                    yield batch([(*r, part, 0, None) for r in done])
        if last is not None:
            yield batch([(last[0], *[None] * 6, part, 2, last[1])])

    fields = to_arrow_schema(StructType.fromDDL(schema))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange(parts(docs), *order).sortWithinPartitions(*order)
    stored = stage(dealt.select("doc_id", "text").mapInArrow(run, schema))
    results = [c.split(" ")[0] for c in _PRINTS.split(", ")]

    # A range's last document (place 2) is followed by the first (place 1) of the next range that has rows.
    lasts = stored.where("place = 2").select("part")
    ring = Window.orderBy("part")
    follows = lasts.select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(
        ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    heads = stored.where("place = 1").select(F.col("part").alias("next"), F.col("text").alias("head"))
    # One narrow row a range: bounded by spark.sql.shuffle.partitions.
    tails = stored.where("place = 2").select("doc_id", "text", "part").join(F.broadcast(follows), "part").join(heads, "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, head in zip(*(c.to_pylist() for c in b.columns)):
                done, _ = _pairs([(i, t), (None, head)], samples)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(done[0], fields)], names=results)

    closed = tails.select("doc_id", "text", "head").mapInArrow(close, _PRINTS.format(key=key))
    return stored.where("place = 0").select(*results).unionByName(closed)
