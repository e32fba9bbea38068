"""Vector codes by product quantisation in whole numbers; nearest entries are found with slice-and-intersect bitmasks.

Every dimension of a codebook keeps its entries' coordinates in order, and for each place in that order the mask of the
entries before it. The entries within a radius of a point in one dimension are then the difference of two masks, and
the AND over all dimensions leaves the entries of a box. A box whose half width reaches the best distance found in it
holds the nearest entry of all, so the distances computed for its members decide exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.llm.common import Scratch, broadcast_bytes, with_group

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components up to this size take part in 64-bit arithmetic; entries are cut to the larger one there.
NORMAL, LARGEST = 1 << 20, 1 << 28
#: Squared differences are computed for about this many (point, candidate) pairs at a time.
PAIRS = 200_000


def scaled(x: float) -> int:
    """floor(SCALE * x) of any finite number."""
    return math.floor(x * SCALE) if abs(x) < 2.0**60 else int(x) * SCALE


class BitSlices:
    """The entries of one codebook, sliced by dimension."""

    def __init__(self, entries: list[list[int]]):
        self.exact = entries
        self.count, self.dim = len(entries), len(entries[0]) if entries else 0
        table = np.array(entries, object).reshape(self.count, self.dim)
        self.cut = np.array([any(abs(x) > LARGEST for x in e) for e in entries], bool)
        self.table = np.clip(table, -LARGEST, LARGEST).astype(np.int64)
        order = np.argsort(self.table, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.table, order, 0).T.copy()
        words = (self.count + 63) // 64
        bit = np.zeros((self.count, words), np.uint64)
        bit[np.arange(self.count), np.arange(self.count) // 64] = np.uint64(1) << (np.arange(self.count) % 64).astype(np.uint64)
        # before[d, i]: the mask of the i entries that come first in dimension d
        self.before = np.zeros((self.dim, self.count + 1, words), np.uint64)
        for d in range(self.dim):
            self.before[d, 1:] = np.bitwise_or.accumulate(bit[order[:, d]], 0)
        self.start = self._start()

    def _start(self) -> int:
        """Half width to begin with: the median over entries of the box that holds their nearest neighbour."""
        if self.count < 2 or not self.dim:
            return 1
        far = np.iinfo(np.int64).max
        nearest = [int(np.partition(np.where(np.arange(self.count) == i, far, np.abs(self.table - self.table[i]).max(1)), 0)[0])
                   for i in range(self.count)]
        return max(1, int(np.median(nearest)))

    def members(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask per point of the entries that are within its radius in every dimension."""
        masks = np.full((len(points), self.before.shape[2]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for d in range(self.dim):
            low = np.searchsorted(self.sorted[d], points[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[d], points[:, d] + radius, "right")
            masks &= self.before[d, high] & ~self.before[d, low]
        return masks

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per point, ties to the lower entry; components of ``points`` are at most NORMAL."""
        n = len(points)
        if not self.dim:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        entry, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        radius, open_ = np.full(n, self.start, np.int64), np.arange(n)
        while len(open_):
            masks = self.members(points[open_], radius[open_])
            held = np.bitwise_count(masks).sum(1).astype(np.int64)
            radius[open_[held == 0]] *= 2
            at, masks, held = open_[held > 0], masks[held > 0], held[held > 0]
            bounds = np.searchsorted(np.cumsum(held), np.arange(PAIRS, held.sum() + PAIRS, PAIRS), "right")
            for a, b in zip(np.concatenate(([0], bounds[:-1] + 1)).tolist(), np.minimum(bounds + 1, len(at)).tolist()):
                if a < b:
                    entry[at[a:b]], best[at[a:b]] = self._among(points[at[a:b]], masks[a:b], held[a:b])
            inside = best[at] <= radius[at] ** 2
            # otherwise the nearest lies within the best distance so far, rounded up
            radius[at[~inside]] = np.ceil(np.sqrt(best[at[~inside]].astype(float))).astype(np.int64) + 1
            open_ = np.concatenate((open_[~np.isin(open_, at)], at[~inside])) if len(at) < len(open_) else at[~inside]
        return entry, best

    def _among(self, points: np.ndarray, masks: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(np.ascontiguousarray(masks.astype("<u8")).view(np.uint8), axis=1, bitorder="little")
        who, which = np.nonzero(bits)
        gap = points[who] - self.table[which]
        distance = np.einsum("ij,ij->i", gap, gap)
        first = np.cumsum(held) - held
        best = np.minimum.reduceat(distance, first)
        winner = np.where(distance == np.repeat(best, held), which, self.count)
        return np.minimum.reduceat(winner, first), best

    def nearest_any(self, points: list[list[int]]) -> tuple[list[int], list[int]]:
        """``nearest`` for whole numbers of any size."""
        entry, best = [], []
        for p in points:
            all_ = [sum((x - y) ** 2 for x, y in zip(p, e)) for e in self.exact]
            best.append(min(all_, default=0))
            entry.append(all_.index(best[-1]) if all_ else 0)
        return entry, best


class Codebooks:
    """One ``BitSlices`` per part."""

    def __init__(self, books: list[list[list[int]]], bounds: list[int]):
        self.bounds, self.slices = bounds, [BitSlices(b) for b in books]

    def assign(self, vectors: np.ndarray) -> tuple[list[list[int]], np.ndarray, list[list[int]], list[int]]:
        """Whole-number components, entries (rows, parts), and squared distances per row and part, summed up last."""
        whole = np.floor(vectors * float(SCALE))
        small = (np.abs(whole) <= NORMAL).all(1) if whole.size else np.ones(len(vectors), bool)
        number = np.where(small[:, None], whole, 0).astype(np.int64)
        exact = {int(r): [scaled(x) for x in vectors[r].tolist()] for r in np.flatnonzero(~small)}
        entries, errors = np.zeros((len(vectors), len(self.slices)), np.int64), [0] * len(vectors)
        for p, s in enumerate(self.slices):
            a, b = self.bounds[p], self.bounds[p + 1]
            entries[:, p], best = s.nearest(number[:, a:b])
            best = best.tolist()
            # cut entries are farther than any other; they win only where all are cut
            again = np.flatnonzero(~small | s.cut[entries[:, p]]) if s.count else []
            if len(again):
                rows = again.tolist()
                found, far = s.nearest_any([exact[r][a:b] if r in exact else number[r, a:b].tolist() for r in rows])
                entries[rows, p] = found
                for r, x in zip(rows, far):
                    best[r] = x
            errors = [x + y for x, y in zip(errors, best)]
        return number, entries, exact, errors


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding as doubles, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", "label", v.alias("embedding")).where(F.col("embedding").isNotNull() & fine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _next_books(rows: DataFrame, books: Codebooks, dim: int) -> list[list[list[int]]]:
    """Entries after one round: the floored means of their parts, or as before where none took them.

    A task adds up its own parts per entry; the sums of all tasks for an entry meet in one group, of as many rows as
    there are tasks. Sums travel as decimal text, so they are exact for any size.
    """
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            number, entries, exact, _ = books.assign(_matrix(b.column(0), dim))
            for p in range(len(books.slices)):
                lo, hi = books.bounds[p], books.bounds[p + 1]
                count = np.bincount(entries[:, p], minlength=ENTRIES)
                part = np.zeros((len(count), hi - lo), np.int64)
                np.add.at(part, entries[:, p], number[:, lo:hi])
                for e in np.flatnonzero(count).tolist():
                    old = total.setdefault((p, e), [0, [0] * (hi - lo)])
                    old[0] += int(count[e])
                    old[1] = [x + y for x, y in zip(old[1], part[e].tolist())]
            for r, numbers in exact.items():  # their place in ``number`` is zero
                for p in range(len(books.slices)):
                    lo, hi = books.bounds[p], books.bounds[p + 1]
                    old = total[p, int(entries[r, p])]
                    old[1] = [x + y for x, y in zip(old[1], numbers[lo:hi])]
        keys = list(total)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _ in keys], pa.int32()), "entry": pa.array([e for _, e in keys], pa.int32()),
            "n": pa.array([total[k][0] for k in keys], pa.int64()),
            "sums": pa.array([[str(x) for x in total[k][1]] for k in keys], pa.list_(pa.string()))})

    def merged(group: pa.Table) -> pa.Table:
        n, sums = 0, None
        for count, texts in zip(group["n"].to_pylist(), group["sums"].to_pylist()):
            n += count
            sums = [int(x) for x in texts] if sums is None else [x + int(y) for x, y in zip(sums, texts)]
        return pa.table({"part": group["part"].slice(0, 1), "entry": group["entry"].slice(0, 1),
                         "mean": pa.array([[str(x // n) for x in sums]], pa.list_(pa.string()))})

    sums = rows.select("embedding").mapInArrow(summed, "part int, entry int, n long, sums array<string>")
    new = [[list(e) for e in s.exact] for s in books.slices]
    for row in sums.groupBy("part", "entry").applyInArrow(merged, "part int, entry int, mean array<string>").collect():  # one row an entry
        new[row["part"]][row["entry"]] = [int(x) for x in row["mean"]]
    return new


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             max_broadcast: int | None = None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of (vec_id, embedding, label).

    Codebooks start from the ``entries`` (256 at most) smallest vec_ids, equal ones in the order of their vectors, null
    ones last, and are refined ``rounds`` times. Rows whose vector is null or holds null or non-finite components are
    left out, as are rows whose length differs from the most frequent one (the longest, if several are). Parts are cut
    as evenly as lengths allow. Fewer rows than ``entries`` make smaller codebooks; repeated rows are coded each; null
    labels are equal to each other; an error too large for a long is null, and with it
    its label's sum; an empty table gives no rows; other columns
    are ignored. Codebooks have a fixed size and are all that the driver holds.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "codes")
    rows = _usable(vectors)
    size = F.size("embedding")
    common = rows.groupBy(size.alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = common[0]["dim"] if common else 0
    rows = rows.where(size == dim)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    bounds = [dim * p // parts for p in range(parts + 1)]
    start = [[scaled(x) for x in r["embedding"]] for r in first]
    books = Codebooks([[v[a:b] for v in start] for a, b in zip(bounds, bounds[1:])], bounds)
    for _ in range(rounds if first else 0):
        books = Codebooks(_next_books(rows, books, dim), bounds)
    digest = hashlib.sha256(",".join(str(x) for s in books.slices for e in s.exact for x in e).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, codes, _, errors = shared.value.assign(_matrix(b.column(2), dim))
            text = [r.tobytes().hex() for r in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()),
                 pa.array([e if e < 2**63 else None for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])

    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    codes = scratch.keep(rows.mapInArrow(coded, f"vec_id {id_type}, label {label_type}, code string, error long"), "codes")
    whole = F.count("error") == F.count(F.lit(1))
    by_label = codes.groupBy(F.col("label").alias("group_key")).agg(
        F.when(whole, F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long").alias("label_error"), F.count(F.lit(1)).alias("group_rows"))
    return with_group(codes, by_label, "label", broadcast_bytes(max_broadcast)).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
