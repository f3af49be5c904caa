"""Contiguous shards of near-equal bytes: cuts at equal targets of the global byte prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siloml.functions.staging import stage
from siloml.llm.common import join_measured, prefix_sums


def balanced_shards(df: DataFrame, n: int, order: list[Column], size: Column) -> DataFrame:
    """Deal rows, in ``order``, into ``n`` contiguous shards of near-equal summed ``size``.

    Returns ``row`` (a struct of df's columns, so that no name can clash), ``size``, ``shard`` (0 to n - 1) and
    ``slot`` (the row's place in its shard, from 0). A row belongs to the shard in whose span of
    [0, total) its middle lies, so a shard differs from total / n by at most one row's size. Rows larger than a
    shard leave neighbours empty. Ties in ``order`` come in any order; an empty table gives no rows; sizes must
    be positive and not null.
    """
    summed = prefix_sums(df, order, size)
    total = summed.agg(F.coalesce(F.max(F.col("before") + F.col("size")), F.lit(1))).first()[0]
    # 2 * total * n stays below 2^63 up to 4 EB / n.
    shard = F.expr(f"(2 * before + size) * {n}L div {2 * total}L")
    dealt = summed.withColumn("shard", F.least(shard.cast("int"), F.lit(n - 1)))
    firsts = stage(dealt.groupBy("shard").agg(F.min("index").alias("first")))
    return join_measured(dealt, firsts, "shard", "inner").select(
        "row", "size", "shard", (F.col("index") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, n: int) -> DataFrame:
    """Documents in doc_id order (nulls first, copies by text hash) cut into ``n`` shards by UTF-8 bytes plus one."""
    narrow = stage(docs.select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("bigint").alias("bytes"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")))
    dealt = balanced_shards(narrow, n, [F.col("doc_id"), F.col("text_crc32"), F.col("bytes")], F.col("bytes"))
    return dealt.select("row.doc_id", "size", "row.text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, n: int, path: str, column: str = "shard") -> None:
    """Write whole documents as ``path/<column>=k/...``, each shard sorted in its order."""
    text = F.coalesce("text", F.lit(""))
    dealt = balanced_shards(docs, n, [F.col("doc_id"), F.crc32(text)], F.octet_length(text) + F.lit(1))
    rows = dealt.select("row.*", F.col("shard").alias(column), F.col("slot").alias("__slot"))
    rows.repartitionByRange(n, column, "__slot").sortWithinPartitions(column, "__slot").drop("__slot").write.partitionBy(
        column).parquet(path)
