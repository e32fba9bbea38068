"""Quality rules whose thresholds adapt to each language and source through mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetflow.llm.common import Scratch
from streetflow.llm.text_stats import rule_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: (metric in units of 1/1000, numerator, denominator, percent of texts below the lower limit, percent up to the upper one)
#: Ordinary prose holds hardly any symbols, so their limit may lie lower in the tail.
METRICS = (
    ("word_length", "word_chars", "n_words", 1, 99),
    ("symbols", "n_symbols", "n_words", None, 95),
    ("dup_lines", "n_dup_lines", "n_lines", None, 99),
    ("repeats", "n_repeat_words", "n_words", None, 99),
)
#: A sketch keeps this many leading binary digits of a value: buckets are at most 1/32 of their value wide.
DIGITS = 5


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; null texts count as empty."""
    kept = docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes if n != "text") + "".join(f", {c} long" for c in COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = rule_counts(b.column(3))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), *[pa.array(counts[c], pa.int64()) for c in COUNTS]],
                ["doc_id", "lang", "source", *COUNTS])

    return kept.mapInArrow(count, schema)


def bucket(value: Column) -> Column:
    """Sketch bucket of a whole number from 0 on: exact up to 2^DIGITS, then 2^DIGITS buckets for each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - (DIGITS + 1), F.lit(0))
    return (shift * (1 << DIGITS) + F.floor(value / F.pow(F.lit(2), shift))).cast("long")


def bucket_value(number: Column) -> Column:
    """Smallest value of a bucket."""
    width = 1 << DIGITS
    shift = F.greatest(F.floor(number / width) - 1, F.lit(0))
    return ((number - shift * width) * F.pow(F.lit(2), shift)).cast("long")


def ratio(top: str, below: str) -> Column:
    """1000 * top / below, rounded down; 0 without a denominator."""
    return F.when(F.col(below) > 0, F.floor(F.col(top) * 1000 / F.col(below))).otherwise(0).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def sketch(counts: DataFrame) -> DataFrame:
    """Mergeable sketches of the texts that pass the base rules, which alone are judged further: rows per (lang, source,
    metric, bucket). Two sketches merge by adding their rows."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(ratio(a, b)).alias("bucket")) for m, a, b, *_ in METRICS])
    return (counts.where(~base_failed()).select("lang", "source", F.explode(cells).alias("c"))
            .groupBy("lang", "source", "c.metric", "c.bucket").agg(F.count(F.lit(1)).alias("rows")))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """n, low and high per group and metric, from the sketches merged to ``keys``: the least value of the bucket of the
    lower quantile and the greatest of that of the upper one, so that no value of these buckets lies outside."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("rows").alias("rows"))
    group = Window.partitionBy(*keys, "metric")
    run = merged.withColumn("n", F.sum("rows").over(group)).withColumn(
        "upto", F.sum("rows").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    first, last = bucket_value(F.col("bucket")), bucket_value(F.col("bucket") + 1) - 1
    low, high = F.lit(0).cast("long"), F.lit(None).cast("long")
    for m, _, _, below, upto in METRICS:
        of = F.col("metric") == m
        if below is not None:
            low = F.when(of, F.when(F.col("upto") * 100 >= F.col("n") * below, first)).otherwise(low)
        high = F.when(of, F.when(F.col("upto") * 100 >= F.col("n") * upto, last)).otherwise(high)
    return run.groupBy(*keys, "metric").agg(F.max("n").alias("n"), F.min(low).alias("low"), F.min(high).alias("high"))


def thresholds(sketches: DataFrame, min_rows: int) -> DataFrame:
    """low_<metric> and high_<metric> per (lang, source), quantiles of that group's texts.

    A group of fewer than ``min_rows`` texts takes the merged sketch of its language, and a language of fewer that of
    all texts.
    """
    own = quantiles(sketches, ["lang", "source"])
    lang = quantiles(sketches, ["lang"]).select(
        F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), *[F.col(c).alias(f"l_{c}") for c in ("n", "low", "high")])
    every = quantiles(sketches, []).select(F.col("metric").alias("a_metric"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    joined = own.join(lang, own["lang"].eqNullSafe(lang["l_lang"]) & (own["metric"] == lang["l_metric"])).join(
        F.broadcast(every), own["metric"] == every["a_metric"])  # one row per metric

    def level(c: str) -> Column:
        return F.when(F.col("n") >= min_rows, F.col(c)).when(F.col("l_n") >= min_rows, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))

    limits = joined.select("lang", "source", "metric", level("low").alias("low"), level("high").alias("high"))
    return limits.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}") for m, *_ in METRICS for c in ("low", "high")])


def filter_by_rules(docs: DataFrame, min_rows: int = 100) -> DataFrame:
    """Verdict per row of (doc_id, text, lang, source, …): doc_id, lang, source, the counts, base_failed, kept.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated five-word windows. kept: not
    base_failed, and every metric within the limits of the row's language and source, which the join brings. Null
    languages and sources are groups of their own, null and empty texts fail, repeated rows are judged each by itself,
    an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    counts = scratch.keep(measured(docs), "counts")
    sketches = scratch.keep(sketch(counts), "sketches")
    limits = thresholds(sketches, min_rows).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    judged = counts.join(
        limits, counts["lang"].eqNullSafe(limits["t_lang"]) & counts["source"].eqNullSafe(limits["t_source"]), "left")
    failed = base_failed()
    inside = F.lit(True)
    for m, a, b, *_ in METRICS:
        inside = inside & ratio(a, b).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    return judged.select("doc_id", "lang", "source", *COUNTS, failed.alias("base_failed"),
                         (~failed & F.coalesce(inside, F.lit(False))).alias("kept"))
