"""URL rules by host and path prefix: a sorted sweep over reversed-host keys."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siloml.functions.staging import stage
from siloml.llm.common import join_measured

SALT_ROWS = 100_000  # probes of one host that are swept in one window
RULES = "host string, path string, verdict string"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.", -1)))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULES)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """For each rule its ``host``, ``key`` (its path) and ``stack``: its own and all rules of its host that enclose it.

    A rule's interval holds the keys that its path begins, so the enclosing rules are those whose path is a
    prefix: each rule is met with the prefixes of its own path. Rules of one host and path: the first verdict
    in order counts.
    """
    once = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    longs = once.withColumn("prefix", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))))
    enclosing = once.select("host", F.col("path").alias("prefix"), "verdict")
    met = longs.drop("verdict").join(enclosing, ["host", "prefix"])
    return met.groupBy("host", F.col("path").alias("key")).agg(
        F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("size"), "prefix", "verdict")), False).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every ``url`` of ``pages`` (all its columns are kept in the struct ``row``): host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with its path; the
    longest rule (host and path) wins; ``default`` is the verdict where none fits (rule null).

    Distinct (host, path) pairs are probed once for each enclosing domain that has rules. A domain, written with
    its labels reversed, and a path are one key, and a rule is the interval of keys that it begins. Rules and
    probes of a domain are sorted together and swept: the last rule passed has the stack of rules that are open
    there, and the innermost of them that still holds the key is the domain's longest. Probes of a domain with
    many are dealt over salts, each with the domain's rules. Null urls have empty host and path; copies stay
    rows; an empty table gives no rows.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    urls = stage(rows.select("host", "path").distinct())
    stacks = stage(rule_stacks(rules).select(reversed_host(F.col("host")).alias("domain"), "host", "key", "stack"))
    # The domains that enclose a host: what stands after each of its points, and itself.
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat_ws(
        ".", F.slice(F.reverse(labels), F.lit(1), n)))
    ruled = stage(stacks.select("domain").distinct())
    probes = stage(join_measured(urls.withColumn("domain", F.explode(suffixes)), ruled, "domain", "left_semi"))
    salts = stage(probes.groupBy("domain").agg(F.expr(f"cast((count(*) - 1) div {SALT_ROWS} + 1 as int)").alias("salts")))
    salts = salts.withColumn("salts", F.greatest("salts", F.lit(64)))
    opened = stacks.join(salts, "domain").select(
        "domain", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", F.lit(0).alias("probe"),
        "stack", F.col("host").alias("rule_host"), F.lit(None).cast("string").alias("host"))
    asked = join_measured(probes, salts, "domain", "inner").select(
        "domain", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"), F.col("path").alias("key"),
        F.lit(1).alias("probe"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"),
        F.lit(None).cast("string").alias("rule_host"), "host")
    sweep = Window.partitionBy("domain", "salt").orderBy("key", "probe").rowsBetween(Window.unboundedPreceding, 0)
    swept = opened.unionByName(asked).withColumns({
        "stack": F.last("stack", ignorenulls=True).over(sweep),
        "rule_host": F.last("rule_host", ignorenulls=True).over(sweep)}).where("probe = 1 and stack is not null")
    held = F.get(F.filter("stack", lambda r: F.startswith(F.col("key"), r["prefix"])), F.lit(0))
    best = swept.withColumn("r", held).where("r is not null").select(
        "host", F.col("key").alias("path"), F.struct(
            (F.length("rule_host") + F.col("r.size")).alias("size"),
            F.concat("rule_host", "r.prefix").alias("rule"), F.col("r.verdict").alias("verdict")).alias("best"))
    judged = stage(best.groupBy("host", "path").agg(F.max("best").alias("best")))
    return join_measured(rows, judged, ["host", "path"]).select(
        "row", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
