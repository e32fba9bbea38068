"""Nearest neighbours by inner product from robust-pruned directed graphs, one per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetflow.llm.common import Scratch

#: Distinct vectors of a shard, on average: what one task holds.
SHARD_ROWS = 16_384
#: Queries that one task searches a shard with.
QUERY_BLOCK = 20_000
#: Neighbours kept by pruning, room for more until the next pruning, beam width in building, relaxation of distances.
DEGREE, ROOM, BUILD_BEAM, ALPHA = 32, 48, 64, 1.2
#: Searches that advance together, and beam entries that each expands at a time.
TOGETHER, EXPAND = 256, 4


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors with one more component that makes all norms equal: the nearest to a query with a 0 there in Euclidean
    distance is the one of largest inner product."""
    norm = (x * x).sum(1)
    return np.hstack([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]]).astype(np.float32)


def beam_search(x: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and squared distances of the best ``width`` vectors found for each query, nearest first."""
    m, half = len(queries), (x * x).sum(1)
    beam, far = np.full((m, width), -1, np.int64), np.full((m, width), np.inf, np.float32)
    done = np.zeros((m, width), bool)
    seen = np.zeros((m, len(x)), bool)
    beam[:, 0], seen[:, start] = start, True
    far[:, 0] = half[start] - 2 * (queries @ x[start])
    rows = np.arange(m)
    while len(rows):
        open_far = np.where(done[rows], np.inf, far[rows])
        pick = np.argpartition(open_far, EXPAND - 1, 1)[:, :EXPAND] if width > EXPAND else np.argsort(open_far, 1)
        live = np.isfinite(np.take_along_axis(open_far, pick, 1))
        going = live.any(1)
        rows, pick, live = rows[going], pick[going], live[going]
        if not len(rows):
            break
        done[rows[:, None], pick] |= live
        near = np.where(live[:, :, None], links[np.take_along_axis(beam[rows], pick, 1)], -1)
        fresh = np.zeros(near.shape, bool)
        for e in range(near.shape[1]):
            ids = near[:, e]
            fresh[:, e] = (ids >= 0) & ~seen[rows[:, None], np.maximum(ids, 0)]
            r, c = np.nonzero(fresh[:, e])
            seen[rows[r], ids[r, c]] = True
        near, fresh = near.reshape(len(rows), -1), fresh.reshape(len(rows), -1)
        r, c = np.nonzero(fresh)
        found = np.full(near.shape, np.inf, np.float32)
        ids = near[r, c]
        found[r, c] = half[ids] - 2 * np.einsum("ij,ij->i", x[ids], queries[rows[r]])
        all_far = np.hstack([far[rows], found])
        best = np.argpartition(all_far, width - 1, 1)[:, :width]
        far[rows] = np.take_along_axis(all_far, best, 1)
        beam[rows] = np.take_along_axis(np.hstack([beam[rows], near]), best, 1)
        done[rows] = np.take_along_axis(np.hstack([done[rows], np.zeros(near.shape, bool)]), best, 1)
    order = np.argsort(far, 1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    beam = np.where(np.isfinite(far), np.take_along_axis(beam, order, 1), -1)
    return beam, far + (queries * queries).sum(1)[:, None]


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point up to ``degree`` of its candidates (-1: none): the nearest one, again and again, each time
    striking out those that lie closer to it, ``alpha`` times relaxed, than to the point."""
    ids = np.where(candidates == points[:, None], -1, candidates)
    order = np.argsort(ids, 1, kind="stable")
    ids = np.take_along_axis(ids, order, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    vectors = x[np.maximum(ids, 0)]
    own = ((vectors - x[points][:, None, :]) ** 2).sum(2)
    left = np.where(ids >= 0, own, np.inf)
    out = np.full((len(points), degree), -1, np.int64)
    every = np.arange(len(points))
    for k in range(degree):
        pick = left.argmin(1)
        some = np.isfinite(left[every, pick])
        if not some.any():
            break
        out[some, k] = ids[every, pick][some]
        between = ((vectors - vectors[every, pick][:, None, :]) ** 2).sum(2)
        left = np.where(alpha * alpha * between <= own, np.inf, left)
        left[every, pick] = np.inf
    return out


def build(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Links (n, ROOM), -1 where there is none, and the start: the vector nearest the mean.

    Vectors enter in a random order in growing batches. A batch searches the graph so far; what the beams hold are the
    candidates that pruning chooses each new vector's links from. Links back are added, and pruned where room runs out.
    """
    n = len(x)
    links = np.full((n, ROOM), -1, np.int64)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.RandomState(seed).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    at = min(n, 64)
    first = order[:at]
    links[first, :DEGREE] = robust_prune(x, first, np.broadcast_to(first, (at, at)).copy(), DEGREE, ALPHA)
    while at < n:
        new = order[at:at + min(at, 4 * TOGETHER)]
        for part in range(0, len(new), TOGETHER):
            some = new[part:part + TOGETHER]
            beam, _ = beam_search(x, links, start, x[some], BUILD_BEAM)
            links[some, :DEGREE] = robust_prune(x, some, beam, DEGREE, ALPHA)
        source = np.repeat(new, DEGREE)
        target = links[new, :DEGREE].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        begins = np.flatnonzero(np.diff(target, prepend=-1))
        rank = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
        free = (links[target] >= 0).sum(1) + rank
        fits = free < ROOM
        links[target[fits], free[fits]] = source[fits]
        source, target, rank = source[~fits], target[~fits], rank[~fits]
        while len(target):  # the rest in rounds of as many as a pruned list has room for
            over, begins = np.unique(target, return_index=True)
            rank = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
            now = rank < ROOM - DEGREE
            extra = np.full((len(over), ROOM - DEGREE), -1, np.int64)
            extra[np.searchsorted(over, target[now]), rank[now]] = source[now]
            for part in range(0, len(over), TOGETHER):
                some = over[part:part + TOGETHER]
                kept = robust_prune(x, some, np.hstack([links[some], extra[part:part + TOGETHER]]), DEGREE, ALPHA)
                links[some] = -1
                links[some, :DEGREE] = kept
            source, target = source[~now], target[~now]
        at += len(new)
    return links, start


def _matrix(column, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _indexed(table: pa.Table) -> pa.Table:
    links, start = build(lifted(_matrix(table.column("vector"))))
    n = len(links)
    return pa.table({
        "dim": table.column("dim"), "shard": table.column("shard"), "node": pa.array(np.arange(n), pa.int64()), "cls": table.column("cls"),
        "vector": table.column("vector"), "links": pa.array(links.astype(np.int32).tolist(), pa.list_(pa.int32())),
        "start": pa.array(np.full(n, start), pa.int64())})


def search(vectors: DataFrame, query_every: int = 20, k: int = 20, beam: int = 192, shard_rows: int = SHARD_ROWS,
           id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``query_every`` its ``k`` nearest others.

    Distinct vectors are dealt to shards of about ``shard_rows`` by hash; a task builds the graph of a shard, and tasks
    search every shard with a block of queries each. Equal vectors are one node, of whose rows the ``k + 1`` smallest
    ids are kept: no other could be returned. Scores are inner products of the vectors themselves in double precision,
    ties go to the smaller id. Only vectors of one length are compared with each other. Rows whose id or vector is
    null, or whose vector is zero, empty, or holds null, infinite or NaN components, take no part; repeated rows count
    once; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "vamana")
    v = F.transform(F.col(vector_column), lambda c: c.cast("double"))
    good = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
        & F.exists("vector", lambda c: c != 0))
    rows = scratch.keep(good.select("vec_id", "vector", F.sha2(F.array_join(F.transform("vector", lambda c: (c + F.lit(0.0)).cast("string")), ","), 256).alias("cls")))
    first = Window.partitionBy("cls").orderBy("vec_id")
    members = scratch.keep(rows.select("cls", "vec_id").withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= k + 1)
                           .select("cls", "vec_id").distinct())
    distinct, seen = scratch.keep_seen(rows.groupBy("cls").agg(F.any_value("vector").alias("vector")), "distinct")
    n_shards = max(1, -(-seen["n"] // shard_rows))
    shard = F.pmod(F.xxhash64("cls"), F.lit(n_shards)).cast("int")
    index = scratch.keep(distinct.select(F.size("vector").alias("dim"), shard.alias("shard"), "cls", "vector").groupBy("dim", "shard").applyInArrow(
        _indexed, "dim int, shard int, node long, cls string, vector array<double>, links array<int>, start long"), "index")
    asked, seen = scratch.keep_seen(rows.where(F.col("vec_id") % query_every == 0).select(
        F.col("vec_id").alias("query_id"), F.size("vector").alias("dim"), "vector", "cls").dropDuplicates(["query_id", "cls"]), "queries")
    n_blocks = max(1, -(-seen["n"] // QUERY_BLOCK))
    asked = asked.select("query_id", "dim", "vector", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    shards = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def answered(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        ids, near, scores = [], [], []
        if nodes.num_rows and queries.num_rows:
            nodes = nodes.sort_by("node")
            x, q = _matrix(nodes.column("vector")), _matrix(queries.column("vector"))
            links, start = _matrix(nodes.column("links"), np.int64), nodes.column("start")[0].as_py()
            lift, who = lifted(x), queries.column("query_id").to_numpy()
            for at in range(0, len(q), TOGETHER):
                part = np.hstack([q[at:at + TOGETHER], np.zeros((len(q[at:at + TOGETHER]), 1))]).astype(np.float32)
                found, _ = beam_search(lift, links, start, part, beam)
                score = np.where(found >= 0, (x[np.maximum(found, 0)] * q[at:at + TOGETHER][:, None, :]).sum(2), -np.inf)
                best = np.argsort(-score, 1, kind="stable")[:, :k + 1]
                found, score = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
                r, c = np.nonzero(found >= 0)
                ids.append(who[at:at + TOGETHER][r])
                near.append(found[r, c])
                scores.append(score[r, c])
        cls = nodes.column("cls").take(pa.array(np.concatenate(near))) if near else pa.array([], pa.string())
        return pa.table({"query_id": pa.array(np.concatenate(ids) if ids else [], pa.int64()), "cls": cls,
                         "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})

    keys = ["dim", "shard", "block"]
    hits = shards.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(answered, "query_id long, cls string, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.join(members, "cls").where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
