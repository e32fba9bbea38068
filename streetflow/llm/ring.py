"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.llm.common import Scratch, literal_table, ranked

#: The ring has this many positions, so that one is a fixed number of hexadecimal digits.
RING = 16**8
#: Ring cells of 2^20 positions let a row find its arc by an equality.
CELL_BITS = 20


def nodes(spark, n_shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; a shard's nodes do not depend on the number of shards."""
    rows = spark.range(n_shards).withColumnRenamed("id", "shard").withColumn(
        "v", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1)))).select("shard", _position(F.concat_ws("/", F.lit("node"), "shard", "v")).alias("position"))
    return sorted({r["position"]: (r["position"], r["shard"]) for r in rows.orderBy("position", "shard").collect()}.values())


def _position(text):
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def plan(counts: list[int], owners: list[int], n_shards: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot) from rows per arc, arcs clockwise.

    A shard takes at most ``(1 + slack)`` times the mean; without slack the first shards take one row more than the
    others, so that counts are at most one apart. Rows fill their own shard in ring order; what overflows a full shard
    continues clockwise to the next node of a shard with room. All figures are per arc: their number is that of the
    virtual nodes, whatever the number of rows.
    """
    total = sum(counts)
    most = [max(total // n_shards + (s < total % n_shards), int((1 + slack) * total / n_shards)) for s in range(n_shards)]
    used, parts, over = [0] * n_shards, [], []
    for arc, n in enumerate(counts):
        took = min(n, most[owners[arc]] - used[owners[arc]])
        parts.append((arc, 0, took, owners[arc], used[owners[arc]]))
        used[owners[arc]] += took
        over.append((arc, took, n))
    for arc, begin, n in over:
        step = arc
        while begin < n:
            step = (step + 1) % len(owners)
            shard = owners[step]
            took = min(n - begin, most[shard] - used[shard])
            if took:
                parts.append((arc, begin, begin + took, shard, used[shard]))
                used[shard] += took
                begin += took
    return [p for p in parts if p[2] > p[1]]


def shard_rows(docs: DataFrame, n_shards: int = 8, virtual: int = 64, slack: float = 0.0) -> DataFrame:
    """Shard and gapless slot of every row of (doc_id, text, …): doc_id, size, text_crc32, shard, slot.

    A row's place on the ring comes from its doc_id (null is a key of its own); rows of one key are told apart by text
    digest and place in the input, so a key with a third of all rows is split like any other. Size is the text's UTF-8
    bytes (null: none) plus 1. Other columns are ignored; repeated rows are rows of their own; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ring")
    ring = nodes(spark, n_shards, virtual)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"),
        _position(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("position"),
        F.monotonically_increasing_id().alias("row")).withColumn("cell", F.shiftright("position", CELL_BITS))
    # every joined table below has a row per virtual node, overflow or ring cell: fixed numbers, so broadcasts are safe
    arcs = F.broadcast(literal_table(spark, _arc_cells([p for p, _ in ring]), "cell long, arc int, low long, high long"))
    base = scratch.keep(
        keyed.join(arcs, (keyed["cell"] == arcs["cell"]) & (keyed["position"] > arcs["low"]) & (keyed["position"] <= arcs["high"]))
        .select("doc_id", "size", "text_crc32", "position", "row", "arc"), "keys")
    located, before = ranked(scratch, base, ["arc", "position", "doc_id", "text_crc32", "size"], "row")
    found = {r["arc"]: r["n"] for r in base.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    scratch.drop(base)
    owners = [s for _, s in ring] + [ring[0][1]]
    parts = plan([found.get(a, 0) for a in range(len(owners))], owners, n_shards, slack)
    first, total = [], 0
    for a in range(len(owners)):
        first.append(total)
        total += found.get(a, 0)
    parts = F.broadcast(literal_table(spark, [
        (arc, first[arc] + begin, first[arc] + end, shard, slot) for arc, begin, end, shard, slot in parts],
        "arc int, begin long, end long, shard int, slot0 long"))
    placed = located.join(before, "part").withColumn("at", F.col("before") + F.col("idx"))
    return placed.join(parts, (placed["arc"] == parts["arc"]) & (placed["at"] >= parts["begin"]) & (placed["at"] < parts["end"])).select(
        "doc_id", "size", "text_crc32", F.col("shard"), (F.col("slot0") + F.col("at") - F.col("begin")).alias("slot"))


def _arc_cells(starts: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, arc, low, high]: which arcs meet which ring cells; the arc past the last node is the last one."""
    edges = [-1, *starts, RING - 1]
    out = []
    for arc, (low, high) in enumerate(zip(edges, edges[1:])):
        if high > low:
            out += [(cell, arc, low, high) for cell in range((low + 1) >> CELL_BITS, (high >> CELL_BITS) + 1)]
    return out
