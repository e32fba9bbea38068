"""Exact quantiles without bringing a group together.

The built-in exact percentile keeps every distinct value of a group in one task. Here values are
counted first, a histogram with a fixed number of buckets finds the bucket of each wanted rank, and
only the values of those buckets are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streetflow.operators.storage import broadcast_if_small, cut_lineage

BUCKETS_PER_OCTAVE = 2048


def _bucket(v: Column) -> Column:
    """Order-preserving bucket of a double: 2048 per doubling of |v| + 1, so its number is bounded.

    Infinity gets the last bucket.
    """
    size = F.when(F.abs(v) == float("inf"), F.lit(1100.0)).otherwise(F.log2(F.abs(v) + 1.0))
    return (F.signum(v) * F.floor(size * BUCKETS_PER_OCTAVE)).cast("long")


def grouping_sets(df: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Rows repeated once per key set, keys outside the set nulled, ``grain`` naming the set."""
    grains = F.array(*[F.lit(i) for i in range(len(sets))])
    out = df.withColumn("grain", F.explode(grains))
    inside = {k: [i for i, s in enumerate(sets) if k in s] for k in keys}
    return out.withColumns({k: F.when(F.col("grain").isin(inside[k]), F.col(k)) for k in keys})


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    names: list[str], mean: str | None = None, count: str | None = None,
                    weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles (type 7) of ``value`` per ``keys``; NULL values are ignored.

    With ``mean`` / ``count`` the result also has the average and the number of values. ``weight``
    names a column saying how many rows a row stands for.
    """
    keys = keys or ["_all"]
    base = df.withColumn("_all", F.lit(1)) if keys == ["_all"] else df
    counted = (
        base.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v"))
        .agg((F.sum(weight) if weight else F.count("*")).alias("n")).withColumn("b", _bucket(F.col("v")))
    )
    # At most a few hundred thousand buckets exist for any data, however large the group.
    hist = counted.groupBy(*keys, "b").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("s"))
    run = W.partitionBy(*keys).orderBy("b")
    whole = W.partitionBy(*keys)
    placed = hist.select(
        *keys, "b", (F.sum("n").over(run) - F.col("n")).alias("before"), F.sum("n").over(run).alias("upto"),
        F.sum("n").over(whole).alias("total"), F.sum("s").over(whole).alias("sum"))
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("total") - 1) * p), F.ceil((F.col("total") - 1) * p)) for p in probs])))
    wanted = placed.select(
        *keys, "b", "before", "total", "sum",
        F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("upto"))).alias("ranks"),
    ).filter(F.size("ranks") > 0)

    # NULL keys form a group of their own, hence the null-safe join.
    left, right = counted.alias("c"), wanted.alias("w")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in [*keys, "b"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    rows = left.join(right, on).select(
        *[F.col(f"c.{k}").alias(k) for k in [*keys, "b"]], "v", "n", "before", "total", "sum", "ranks")
    inner = W.partitionBy(*keys, "b").orderBy("v")
    located = rows.withColumn("hi", F.col("before") + F.sum("n").over(inner)).withColumn(
        "lo", F.col("hi") - F.col("n"))
    hits = located.select(
        *keys, "v", "total", "sum",
        F.explode(F.filter("ranks", lambda r: (r >= F.col("lo")) & (r < F.col("hi")))).alias("r"))
    return _interpolated(hits, keys, probs, names, mean, count)


def _interpolated(hits: DataFrame, keys: list[str], probs: list[float], names: list[str], mean: str | None,
                  count: str | None) -> DataFrame:
    """Quantiles from the values at the wanted ranks ``r`` of each group."""

    def at(rank):
        return F.max(F.when(F.col("r") == rank, F.col("v")))

    pos = {p: (F.col("total") - 1) * p for p in probs}
    found = hits.groupBy(*keys, "total", "sum").agg(
        *[at(F.floor(pos[p])).alias(f"_l{i}") for i, p in enumerate(probs)],
        *[at(F.ceil(pos[p])).alias(f"_h{i}") for i, p in enumerate(probs)])
    out = [
        F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise(
            F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (pos[p] - F.floor(pos[p]))).alias(name)
        for i, (p, name) in enumerate(zip(probs, names))]
    if mean:
        out.insert(0, (F.col("sum") / F.col("total")).alias(mean))
    if count:
        out.insert(0, F.col("total").alias(count))
    return found.select(*[k for k in keys if k != "_all"], *out)


def rolled_up_quantiles(df: DataFrame, keys: list[str], sets: list[list[str]], value: str, probs: list[float],
                        names: list[str], mean: str | None = None) -> DataFrame:
    """``exact_quantiles`` for several key sets, ``grain`` numbering them, from one count table at the finest grain.

    Coarser histograms are added up from finer ones, one table of wanted ranks serves all sets, and only values in the
    buckets of wanted ranks are repeated for the sets. The count table is written, as both steps read it.
    """
    counted = cut_lineage(
        df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count("*").alias("n")).withColumn("b", _bucket(F.col("v"))), "counts")
    group = ["grain", *keys]
    # partial sums per finest group leave a bounded number of buckets before anything is repeated or moved
    fine = counted.groupBy(*keys, "b").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("s"))
    hist = grouping_sets(fine, keys, sets).repartition(*group).groupBy(*group, "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    run, whole = W.partitionBy(*group).orderBy("b"), W.partitionBy(*group)
    placed = hist.select(
        *group, "b", (F.sum("n").over(run) - F.col("n")).alias("before"), F.sum("n").over(run).alias("upto"),
        F.sum("n").over(whole).alias("total"), F.sum("s").over(whole).alias("sum"))
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("total") - 1) * p), F.ceil((F.col("total") - 1) * p)) for p in probs])))
    wanted, _ = broadcast_if_small(placed.select(
        *group, "b", "before", "total", "sum",
        F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("upto"))).alias("ranks"),
    ).filter(F.size("ranks") > 0))
    left, right = grouping_sets(counted, keys, sets).alias("c"), wanted.alias("w")
    on = F.lit(True)
    for k in [*group, "b"]:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}"))
    found = left.join(right, on).select(
        *[F.col(f"c.{k}").alias(k) for k in [*group, "b"]], "v", "n", "before", "total", "sum", "ranks")
    rows = found.repartition(*group, "b").groupBy(
        *group, "b", "v", "before", "total", "sum", "ranks").agg(F.sum("n").alias("n"))
    inner = W.partitionBy(*group, "b").orderBy("v")
    located = rows.withColumn("hi", F.col("before") + F.sum("n").over(inner)).withColumn("lo", F.col("hi") - F.col("n"))
    hits = located.select(
        *group, "v", "total", "sum",
        F.explode(F.filter("ranks", lambda r: (r >= F.col("lo")) & (r < F.col("hi")))).alias("r"))
    return _interpolated(hits, group, probs, names, mean, None)
