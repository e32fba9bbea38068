"""Scratch tables, gapless ranks and array views of texts shared by the operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from streetflow.operators.storage import BROADCAST_BYTES, broadcast_if_small, remove_dir, shared_dir

#: Texts are turned into numpy arrays in pieces of about this many bytes, whatever the size of an Arrow batch.
PIECE_BYTES = 1_000_000


class Scratch:
    """Tables of one run under the shared folder, written so that later steps reread them after a lost executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/streetflow-{label}-{uuid.uuid4().hex}"
        self.made, self.kept = 0, {}

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{name}-{self.made}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self._reread(df, path)

    def _reread(self, df: DataFrame, path: str) -> DataFrame:
        table = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(table)] = (table, path)
        return table

    def keep_seen(self, df: DataFrame, name: str, **seen: Column) -> tuple[DataFrame, dict]:
        """``keep`` with aggregates taken while writing."""
        obs = Observation()
        path = self.path(name)
        df.observe(obs, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in seen.items()]).write.parquet(path)
        return self._reread(df, path), obs.get

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        remove_dir(self.spark, self.kept.pop(id(df))[1])


def ranked(scratch: Scratch, df: DataFrame, order: list[str], tie: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``part`` and ``idx``, and the table (part, before): ``before + idx`` is a gapless rank by ``order``.

    A range shuffle on the order with the unique column ``tie`` last spreads equal keys over tasks, so no key has to
    fit in one of them. Only one row per partition is summed up in a single task.
    """
    sorted_ = df.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    rows = scratch.keep(sorted_.withColumn("_at", F.monotonically_increasing_id()).select(
        "*", F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("idx")).drop("_at"), "ranked")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, counts.select("part", before.alias("before"))


def broadcast_bytes(given: int | None) -> int:
    return BROADCAST_BYTES if given is None else given


def with_group(rows: DataFrame, groups: DataFrame, key: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the other columns of ``groups``, a table of one row per ``group_key`` that counts its
    ``group_rows``; rows of no group get nulls, a null key is a key.

    ``groups`` is written and broadcast if it has at most ``max_bytes``. Otherwise only groups with more than 1/1024 of
    all counted rows are, 1,023 at most, and the rows of the many small groups meet theirs by a shuffle.
    """
    kept, small = broadcast_if_small(groups, max_bytes)
    if small:
        return rows.join(kept, rows[key].eqNullSafe(kept["group_key"]), "left").drop("group_key", "group_rows")
    total = kept.agg(F.sum("group_rows")).first()[0] or 0
    is_hot = F.col("group_rows") * 1024 > total
    hot, cold = kept.where(is_hot), kept.where(~is_hot)
    names = hot.select(F.col("group_key").alias("hot_key"))
    of_hot = rows.join(F.broadcast(hot), rows[key].eqNullSafe(hot["group_key"]))
    others = rows.join(F.broadcast(names), rows[key].eqNullSafe(names["hot_key"]), "left_anti")
    of_cold = others.join(cold, others[key].eqNullSafe(cold["group_key"]), "left")
    return of_hot.unionByName(of_cold).drop("group_key", "group_rows")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver as one literal of the plan; ``schema`` is like ``"a int, b long"``."""
    names = [c.split()[0] for c in schema.split(",")]
    cells = json.dumps([dict(zip(names, row)) for row in rows])
    kind = "array<struct<" + ", ".join(":".join(c.split()) for c in schema.split(",")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(cells), kind)))


# Texts as arrays ---------------------------------------------------------------------------------------------

#: The white space that separates words: x20 and x09 to x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes unchanged.
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(0, 2**63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts of the rows and the end) of pieces of a string column; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, column = np.int64, column.cast(pa.large_binary())
    else:
        kind, column = np.int32, column.cast(pa.binary())
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, raw[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end, 64-bit hash) of every word of the texts ``data[at[i]:at[i + 1]]``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = at[1:] - 1
    last = last[(at[1:] > at[:-1])]
    ends[last] = inside[last]
    end = np.flatnonzero(ends) + 1
    text = np.searchsorted(at, start, "right") - 1
    return text, start, end, word_hash(TO_LOWER[data] if lower else data, start, end)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices ``data[start:end]``, none of them empty."""
    length = end - start
    if not len(start):
        return np.zeros(0, np.uint64)
    total = int(length.sum())
    from_ = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    pos = np.arange(total, dtype=np.int64)
    inner = pos - np.repeat(np.cumsum(length) - length, length)
    powers = _POWERS if int(length.max()) <= len(_POWERS) else np.multiply.accumulate(
        np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))
    value = _BYTE[data[pos + from_]] * powers[inner]
    return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))


def windows(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of every ``k`` consecutive words; the callers drop windows that run over a text's end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        out ^= out >> np.uint64(29)
    return mix(out)
