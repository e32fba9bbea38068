"""Packing into length buckets whose bounds dynamic programming chooses from the global histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.llm.common import Scratch, literal_table, ranked

#: Histogram bins are exact up to 2^BIN_DIGITS tokens, then 2^BIN_DIGITS for each power of two: at most 13,000 or so
#: for any lengths, usually below 2,000. Bounds are true lengths, so binning only limits where a bound may lie.
BIN_DIGITS = 8


def n_tokens(text: Column) -> Column:
    """An estimate without a tokenizer: a quarter of the UTF-8 bytes of a text rounded up; null has none.

    The queries do not use it but count with ``bpe.token_counts``: by the rank file of op9 texts
    have more tokens than this, about half as many again by the review of round 2.
    """
    return F.ceil(F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) / 4).cast("long")


def length_bin(length: Column) -> Column:
    shift = F.greatest(F.length(F.bin(length)) - (BIN_DIGITS + 1), F.lit(0))
    return (shift * (1 << BIN_DIGITS) + F.floor(length / F.pow(F.lit(2), shift))).cast("long")


def best_bounds(rows: np.ndarray, longest: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least padded tokens in all.

    ``rows[i]`` texts lie in bin i, the longest of them has ``longest[i]`` tokens; bins ascend. Padding is the bound
    times the rows less their tokens, and the tokens do not depend on the bounds, so rows times bound is minimised:
    cost[k][j] = min over i < j of cost[k - 1][i] + (rows in bins i..j - 1) * longest[j - 1].
    """
    n = len(rows)
    if not n:
        return []
    upto = np.concatenate(([0.0], np.cumsum(rows, dtype=np.float64)))
    cost = np.concatenate(([0.0], np.full(n, np.inf)))
    back = []
    for _ in range(min(n_buckets, n)):
        new, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            total = cost[:j] + (upto[j] - upto[:j]) * longest[j - 1]
            choice[j] = int(np.argmin(total))
            new[j] = total[choice[j]]
        cost = new
        back.append(choice)
    bounds, j = [], n
    for choice in reversed(back):
        if j == 0:
            break
        bounds.append(int(longest[j - 1]))
        j = int(choice[j])
    return sorted(set(bounds))


def pack(docs: DataFrame, length: Column, n_buckets: int = 16, batch_tokens: int = 65_536, id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, n_tokens, bucket, padded_to, batch, slot, padding.

    Every bucket pads to its bound; a batch takes ``batch_tokens div bound`` documents of one bucket, and one document
    if a single one is longer. Batches are full but for the last of a bucket and are numbered over all buckets. Inside
    a bucket documents come in an order scrambled by id. Empty texts need no tokens and are packed as one token each;
    null and repeated ids are rows like others; no text is cut. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    sized = scratch.keep(docs.select(
        F.col(id_column), F.greatest(length, F.lit(1)).cast("long").alias("n_tokens"),
        F.monotonically_increasing_id().alias("row")), "lengths")
    bins = sized.groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("n_tokens").alias("longest")).toPandas().sort_values("bin")
    bounds = best_bounds(bins["rows"].to_numpy(np.float64), bins["longest"].to_numpy(np.int64), n_buckets)
    counts = []
    for low, high in zip([0, *bounds], bounds):
        counts.append(int(bins[(bins["longest"] > low) & (bins["longest"] <= high)]["rows"].sum()))
    table, first_row, first_batch = [], 0, 0
    for k, (bound, n) in enumerate(zip(bounds, counts)):
        per_batch = max(1, batch_tokens // bound)
        table.append((k, bound, per_batch, first_row, first_batch))
        first_row, first_batch = first_row + n, first_batch + -(-n // per_batch)
    buckets = F.broadcast(literal_table(spark, table, "bucket int, padded_to long, per_batch long, first_row long, first_batch long"))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    in_bucket = F.size(F.filter(edges, lambda b: b < F.col("n_tokens"))).alias("bucket")
    placed = scratch.keep(sized.select("*", in_bucket, F.xxhash64(F.lit("pack"), F.col(id_column)).alias("scrambled")), "placed")
    rows, before = ranked(scratch, placed, ["bucket", "scrambled"], "row")
    at = F.col("before") + F.col("idx") - F.col("first_row")
    return rows.join(before, "part").join(buckets, "bucket").select(
        id_column, "n_tokens", "bucket", "padded_to", (F.col("first_batch") + F.floor(at / F.col("per_batch"))).cast("long").alias("batch"),
        F.pmod(at, "per_batch").cast("long").alias("slot"), (F.col("padded_to") - F.col("n_tokens")).alias("padding"))
