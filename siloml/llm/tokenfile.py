"""Token files: a wavelet matrix for each shard of token ids, with rank and select over compressed bit planes.

A file holds the ids of consecutive documents. Plane k has bit (width - 1 - k) of each id, in an order in which
the ids with a 0 in the plane before come first (stable). Planes are cut into blocks; a block is compressed by
itself and a directory has the ones before each block, so that access, rank and select unpack one block of a
plane, not the file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from siloml.functions.staging import stage, staging_dir
from siloml.llm.common import join_measured, parts
from siloml.llm.tokens import default_path, encoded_rows, encoder

# The file format.
MAGIC = b"WVM1"
BLOCK_BITS = 1 << 16
HEAD = struct.Struct("<4sBxxxqq")  # magic, planes, documents, ids

FILE_ROW = "part int, seq int, doc_ids array<bigint>, n_tokens bigint, file binary"

SHARD_IDS = 1 << 20  # ids after which a file is closed


def encode_file(ids: np.ndarray, lengths: np.ndarray, planes: int) -> bytes:
    """The file of ``ids`` (documents of the given lengths, one after the other)."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    now = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, ones, sizes, body = [], [], [], []
    for k in range(planes - 1, -1, -1):
        mask = (now & now.dtype.type(1 << k)) != 0
        packed = np.packbits(mask, bitorder="little")
        ends = np.cumsum([np.count_nonzero(mask[i:i + BLOCK_BITS]) for i in range(0, len(mask), BLOCK_BITS)] or [0])
        zeros.append(len(now) - int(ends[-1]))
        ones.append(np.concatenate(([0], ends)))
        for i in range(0, len(packed), BLOCK_BITS // 8):
            raw = packed[i:i + BLOCK_BITS // 8].tobytes()
            short = squeeze(raw)
            body.append(short if len(short) < len(raw) else raw)
            sizes.append(len(body[-1]))
        if k:
            now = np.concatenate((now.compress(~mask), now.compress(mask)))  # faster than indexing by a mask
    return b"".join((
        HEAD.pack(MAGIC, planes, len(lengths), len(ids)), np.asarray(lengths, "<i8").tobytes(),
        np.asarray(zeros, "<i8").tobytes(), np.concatenate(ones).astype("<i8").tobytes() if ones else b"",
        np.asarray(sizes, "<i8").tobytes(), *body))


class TokenFile:
    """Reads one file: the ids of a document, single ids, counts and places of an id."""

    def __init__(self, data: bytes):
        magic, self.planes, docs, self.n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size

        def numbers(count: int) -> np.ndarray:
            nonlocal at
            at += 8 * count
            return np.frombuffer(data, "<i8", count, at - 8 * count)

        self.blocks = -(-self.n // BLOCK_BITS)
        self.starts = np.concatenate(([0], np.cumsum(numbers(docs))))
        self.zeros = numbers(self.planes)
        self.ones = numbers(self.planes * (max(self.blocks, 1) + 1)).reshape(self.planes, -1)
        sizes = numbers(self.planes * self.blocks)
        self.at = (at + np.concatenate(([0], np.cumsum(sizes)))).tolist()
        self.data, self.cache = data, {}

    def _raw(self, plane: int, block: int) -> bytes:
        k = plane * self.blocks + block
        part = self.data[self.at[k]:self.at[k + 1]]
        size = (min(BLOCK_BITS, self.n - block * BLOCK_BITS) + 7) // 8
        return part if len(part) == size else zstandard.ZstdDecompressor().decompress(part, max_output_size=size)

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The block's bits; the last few blocks used stay unpacked."""
        if (plane, block) not in self.cache:
            if len(self.cache) >= 64:
                self.cache.clear()
            bits = np.unpackbits(np.frombuffer(self._raw(plane, block), np.uint8), bitorder="little")
            self.cache[plane, block] = bits[:min(BLOCK_BITS, self.n - block * BLOCK_BITS)]
        return self.cache[plane, block]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        block, rest = divmod(i, BLOCK_BITS)
        return int(self.ones[plane, block]) + (int(self._block(plane, block)[:rest].sum(dtype=np.int64)) if rest else 0)

    def _select(self, plane: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) 0 or 1 of a plane."""
        before = self.ones[plane] if bit else np.minimum(
            np.arange(self.blocks + 1) * BLOCK_BITS, self.n) - self.ones[plane][:self.blocks + 1]
        block = int(np.searchsorted(before, j, side="right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(plane, block) == bit)[j - int(before[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.planes):
            block, rest = divmod(i, BLOCK_BITS)
            bit = int(self._block(k, block)[rest])
            value = 2 * value + bit
            ones = self._rank1(k, i)
            i = int(self.zeros[k]) + ones if bit else i - ones
        return value

    def _span(self, value: int, i: int, j: int) -> tuple[int, int]:
        """The span in the last order that holds the occurrences of an id among positions i to j - 1."""
        if value >> self.planes:
            return 0, 0
        for k in range(self.planes):
            a, b = self._rank1(k, i), self._rank1(k, j)
            if value >> (self.planes - 1 - k) & 1:
                i, j = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                i, j = i - a, j - b
        return i, j

    def count(self, value: int, i: int = 0, j: int | None = None) -> int:
        """How often an id stands among positions i to j - 1 (default: all)."""
        i, j = self._span(value, i, self.n if j is None else j)
        return j - i

    def select(self, value: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of an id."""
        first, last = self._span(value, 0, self.n)
        if not 0 <= j < last - first:
            raise IndexError(j)
        at = first + j
        for k in range(self.planes - 1, -1, -1):
            bit = value >> (self.planes - 1 - k) & 1
            at = self._select(k, bit, at - int(self.zeros[k]) if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids: the planes from the last to the first, each undoing one stable partition."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.planes - 1, -1, -1):
            raw = b"".join(self._raw(k, b) for b in range(self.blocks))
            mask = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:self.n].view(bool)
            z, before = int(self.zeros[k]), np.empty(self.n, kind)
            before[np.flatnonzero(~mask)] = now[:z]
            before[np.flatnonzero(mask)] = now[z:] | kind(1 << (self.planes - 1 - k))
            now = before
        return now

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document, one by one."""
        return np.asarray([self.access(i) for i in range(int(self.starts[k]), int(self.starts[k + 1]))], np.int64)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, in ascending doc_id order, and write the token files as a table under ``path``.

    Rows: ``part`` and ``seq`` (the files' order), ``doc_ids``, ``n_tokens`` and ``file``. Texts are dealt into
    sorted ranges of doc_id (nulls first; copies of an id by their text's hash), each range is encoded in one
    pass and closed into files of about ``shard_ids`` ids (a longer document is one file). A null text counts
    as empty and has the end id alone; an empty table gives no files.
    """
    name = tokenizer or default_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(name), TaskContext.get().partitionId(), 0
        planes = int(len(enc.ends) - 1).bit_length()
        keys, ids, size = [], [], 0

        def closed():
            nonlocal seq, keys, ids, size
            data = encode_file(np.concatenate(ids), np.asarray([len(x) for x in ids]), planes)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([keys], pa.list_(pa.int64())),
                 pa.array([size], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "seq", "doc_ids", "n_tokens", "file"])
            seq, keys, ids, size = seq + 1, [], [], 0
            return row

        for key, found in encoded_rows(enc, batches):
            keys.append(key)
            ids.append(found)
            size += len(found)
            if size >= shard_ids:
                yield closed()
        if keys:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange(parts(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    files = dealt.select("doc_id", "text").mapInArrow(
        encoded, FILE_ROW)
    files.write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start`` (ids of all documents before it), ``ids`` (uint32 LE)."""
    files = spark.read.schema(FILE_ROW).parquet(path)
    # Starts of the files: totals of each part (one row for each writing task), then within the part.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("s")).select(
        "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("p"))
    starts = stage(files.select("part", "seq", "n_tokens").withColumn(
        "q", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(sums, "part").select(
        "part", "seq", (F.col("p") + F.col("q")).alias("base")))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, keys, data in zip(*(b.column(i) for i in range(3))):
                f = TokenFile(data.as_py())
                ids, starts = f.ids().astype("<u4"), f.starts
                n = len(starts) - 1
                blob = pa.Array.from_buffers(pa.large_binary(), n, [
                    None, pa.py_buffer(np.asarray(4 * starts, np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(starts[:-1].astype(np.int64) + base.as_py()), blob.cast(pa.binary())],
                    names=["doc_id", "start", "ids"])

    # The files meet their starts before they are unpacked, so that ids are never shuffled.
    rows = join_measured(files.select("part", "seq", "doc_ids", "file"), starts, ["part", "seq"], "inner")
    return rows.select("base", "doc_ids", "file").mapInArrow(decoded, "doc_id bigint, start bigint, ids binary")


def new_path(spark) -> str:
    return f"{staging_dir(spark)}/tokens-{uuid.uuid4().hex}"


