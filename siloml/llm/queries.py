"""The operators' queries: each applies one to its whole table and derives the digest columns of its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siloml.llm import (embeddings, filteraudit, linededup, mixing, packing, quality, secrets, sharding, simhash,
                        tokenfile, urlrules, vectorcodes, weightedprints)
from siloml.llm.common import read

# The rules and weights that the queries apply.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
SHARDS = 16
COSINE = 0.98


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlrules.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"),
                                 urlrules.rules_table(spark, URL_RULES))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.words().alias("size"))
    return mixing.mix(docs, WEIGHTS, SHARE, EPOCHS).select("doc_id", "size", "source_size", "target", "taken")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"), COSINE)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")

    def of(*kinds):
        return F.filter("found", lambda x: x["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(joined(of(*secrets.KINDS)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
                         quality.base_failed(F.col("m")).alias("base_failed"), "kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(read(spark, sf_dir, "documents"), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.new_path(spark)
    tokenfile.write_token_files(read(spark, sf_dir, "documents"), path)
    return tokenfile.read_token_files(spark, path).select(
        "doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vectorcodes.encode_vectors(read(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("codes", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    return vectorcodes.with_label_errors(coded.select("vec_id", "label", digits.alias("code"), "error")).select(
        "vec_id", "code", "error", "label_error", F.lit(vectorcodes.codebooks_digest(codebooks)).alias("codebooks_sha256"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weightedprints.compare_with_next(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_url_rules, op3_mixing, op4_embeddings, op5_packing, op6_secrets,
                                   op7_quality, op8_sharding, op9_line_dedup, op10_token_files, op11_filter_audit,
                                   op12_vector_codes, op13_fingerprints)}
