"""Quality rules whose cutoffs are chosen on labelled documents under exact binomial risk bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from siloml.functions.staging import stage
from siloml.llm.common import SPACE, join_measured, let

# The base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

# The method's rules: a document is rejected if the ratio exceeds the stratum's cutoff. Cutoffs are candidates.
CUTOFFS = {
    "symbols": (0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0),  # symbols per word
    "repeated": (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),  # share of words in repeated windows
    "dup_lines": (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),  # share of lines that repeat
    "word_size": (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0),  # characters per word
}
RISK = 0.0025  # most good documents that one rule may reject in a stratum, as a share
DELTA = 0.05  # chance that any of all tested cutoffs passes by luck


def word_list(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def covered(starts: Column, width: int) -> Column:
    """Words covered by windows of ``width`` words at the sorted, distinct ``starts``."""
    steps = F.transform(starts, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - p, F.lit(width))))
    return F.aggregate(steps, F.lit(0), lambda a, s: a + s)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words that occurs twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes of their words within one text. Only texts with a repeated window
    sort their windows.
    """
    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return let(F.sort_array(F.transform(same, lambda x: x["p"])), lambda p: covered(p, width))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, of_sorted))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(
        *[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(hashes, of_hashes))


def measures(text: Column) -> Column:
    """A struct of a text's measures; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    by_word = let(word_list(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("rep")))
    return let(F.struct(by_line.alias("l"), by_word.alias("w")), lambda m: F.struct(*[c.cast("bigint").alias(n) for n, c in (
        ("n_words", m["w"]["n"]), ("word_chars", chars), ("n_symbols", symbols), ("n_dup_lines", m["l"]["dup"]),
        ("n_repeat_words", m["w"]["rep"]), ("n_lines", m["l"]["n"]))]))


def ratios(m: Column) -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.when(m[b] > 0, m[a] / m[b]).otherwise(0.0)

    return {"symbols": share("n_symbols", "n_words"), "repeated": share("n_repeat_words", "n_words"),
            "dup_lines": share("n_dup_lines", "n_lines"), "word_size": share("word_chars", "n_words")}


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def log_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0 by Stirling's series, eight terms further up."""
    x = n + F.lit(8.0)
    up = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.log(n + k)), F.lit(0.0), lambda a, b: a + b)
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
    return series - up


def most_allowed(n: Column, risk: float, level: float) -> Column:
    """Largest k with P(Binomial(n, risk) <= k) <= level, -1 if there is none.

    The sum starts 45 standard deviations below the mean, where a term is below 1e-300, and ends at the mean.
    """
    def summed(first: Column) -> Column:
        start = (log_factorial(n) - log_factorial(first) - log_factorial(n - first)
                 + first * math.log(risk) + (n - first) * math.log1p(-risk))
        zero = F.struct(start.alias("t"), F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("k"))

        def step(a: Column, j: Column) -> Column:
            total = a["sum"] + F.exp(a["t"])
            odds = F.when(n > j, F.log((n - j) / (j + 1)) + math.log(risk / (1 - risk))).otherwise(-1e9)
            return F.struct((a["t"] + odds).alias("t"), total.alias("sum"), F.when(total <= level, j).otherwise(a["k"]).alias("k"))

        return F.aggregate(F.sequence(first, F.ceil(n * risk)), zero, step)["k"]

    first = F.greatest(F.lit(0), F.floor(n * risk - 45 * F.sqrt(n * risk * (1 - risk)))).cast("bigint")
    return let(first, summed)


def _counted(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """For each stratum the labelled good documents ``n`` and those that each cutoff rejects, stored."""
    good = stage(labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id"))
    held = join_measured(measured, good, "doc_id", "left_semi")
    counts = [F.count(F.when(r > c, 1)).alias(f"{name}_{i}") for name, r in ratios(F.col("m")).items()
              for i, c in enumerate(CUTOFFS[name])]
    return stage(held.groupBy("stratum").agg(F.count("*").alias("n"), *counts))


def _lowest(allowed: DataFrame) -> DataFrame:
    return allowed.select("stratum", *[
        F.least(F.lit(None).cast("double"), F.lit(None).cast("double"), *[
            F.when(F.col(f"{name}_{i}") <= F.col("k"), F.lit(c)) for i, c in enumerate(CUTOFFS[name])]).alias(name)
        for name in CUTOFFS])


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """For each stratum the lowest proven cutoff of every rule, null where none is proven.

    ``measured`` has doc_id, stratum and the struct m; ``labels`` has doc_id and quality (1: good). A cutoff is
    proven if the good documents of the stratum that it rejects are so few that, were its true share of false
    rejections above ``risk``, so few would turn up with a chance of at most ``delta`` divided by the number of
    all tests (rules, cutoffs and strata). All labelled documents count. A document with several labels is
    good if all are 1; without a good document there is no cutoff.
    """
    counted = _counted(measured, labels)
    tests = sum(map(len, CUTOFFS.values())) * max(1, counted.count())
    return _lowest(counted.withColumn("k", most_allowed(F.col("n"), risk, delta / tests)))


def pooled_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Like ``cutoffs``, by tests in a fixed sequence and with a pool for strata with too few labels.

    A rule's cutoffs are tested from the loosest to the tightest and the first that isn't proven ends them, so
    ``delta`` is divided by the rules and strata only. The pool, all labelled good documents, is one stratum more;
    its cutoffs count for a stratum whose own labels could not prove a cutoff that rejects none of them.
    """
    counted = _counted(measured, labels)
    names = [c for c in counted.columns if c != "stratum"]
    level = delta / (len(CUTOFFS) * (counted.count() + 1))
    pool = counted.agg(*[F.sum(c).alias(f"pool_{c}") for c in names])
    enough = F.col("n") * math.log1p(-risk) <= math.log(level)
    chosen = counted.crossJoin(F.broadcast(pool)).select(
        "stratum", *[F.when(enough, F.col(c)).otherwise(F.col(f"pool_{c}")).alias(c) for c in names])
    return _lowest(chosen.withColumn("k", most_allowed(F.col("n"), risk, level)))


def verdict(m: Column, cuts: DataFrame) -> Column:
    """True for documents to keep, given the stratum's cutoffs as columns."""
    over = F.lit(False)
    for name, r in ratios(m).items():
        over = over | F.coalesce(r > cuts[name], F.lit(False))
    return ~base_failed(m) & ~over


def measure_documents(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (lang) and the measures of every whole text, stored."""
    return stage(docs.select("doc_id", F.col("lang").alias("stratum"), measures(F.col("text")).alias("m")))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's doc_id, stratum, measures m and ``kept``; strata are languages, null one of its own."""
    measured = measure_documents(docs)
    cuts = stage(pooled_cutoffs(measured, labels).withColumnRenamed("stratum", "of"))
    joined = join_measured(measured, cuts, F.col("stratum").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "stratum", "m", verdict(F.col("m"), cuts).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents to keep, with all their columns. Texts are measured once, stored with their measures and not moved."""
    measured = stage(docs.withColumns({"__stratum": F.col("lang"), "__m": measures(F.col("text"))}))
    narrow = measured.select("doc_id", F.col("__stratum").alias("stratum"), F.col("__m").alias("m"))
    cuts = stage(pooled_cutoffs(narrow, labels).withColumnRenamed("stratum", "__of"))
    cuts = cuts.select("__of", *[F.col(c).alias(f"__{c}") for c in CUTOFFS])
    joined = join_measured(measured, cuts, F.col("__stratum").eqNullSafe(F.col("__of")))
    kept = verdict(F.col("__m"), {c: F.col(f"__{c}") for c in CUTOFFS})
    return joined.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
