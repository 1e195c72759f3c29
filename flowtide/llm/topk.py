"""Exact top-k inner products by no-random-access aggregation.

Vectors become integers, floor(1024 x), and are packed into blocks of rows. In a
block each dimension is a list of rows sorted by value. A query reads its lists in step, each from
the end that is best for the sign of its component, and adds what it reads to the rows' partial
scores; nothing is looked up by row. A row's score is at least its partial score with the worst
value of every list in which it hasn't been met, and at most that with the value that each of these
lists has been read down to. Reading stops when no more than a few rows can be among
the k best, whose final scores are then resolved.

Blocks are dealt over buckets, each of which has every query once: a bucket's
queries carry what they know of their k-th best score from block to block, so that later
blocks end sooner. The best k of each block are merged per query.

Cases: vectors that are null, empty, or hold a null or non-finite component take
no part; vectors of another length aren't comparable and aren't candidates of each
other; repeated vec_ids are rows of their own (a query leaves out its own row
only); ties go to the smaller vec_id; fewer than k candidates are all returned; scores are
64-bit integers and wrap beyond them; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, session

SCALE = 1024
#: Vectors of a block.
BLOCK = 4096
#: Rows of each list that are read at first, as a share (each later reading doubles what has been read), and
#: candidates, as a multiple of k, that are few enough to be resolved.
FIRST, FEW = 1 / 16, 2


class Lists:
    """The sorted lists of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.rows = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T).astype(np.int64)
        self.top = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.read = 0  # entries read so far, by all queries

    def candidates(self, query: np.ndarray, mine: int, k: int, known: float = -np.inf) -> np.ndarray:
        """Rows that hold the k best scores that are at least `known`, and few others; never the query's own row `mine`."""
        n, d = self.vectors.shape
        # Sums of whole numbers are exact in doubles below 2**53, in 64-bit integers anyway.
        kind = np.float64 if self.top * float(np.abs(query).max(initial=0)) * d < 2**52 else np.int64
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        value = np.append(query[up], query[down]).astype(kind)[:, None]
        worst = np.append(self.values[up, 0], self.values[down, -1]).astype(kind) * value[:, 0]
        part, met = np.zeros(n, kind), np.zeros((len(value), n), kind)
        alive = np.delete(np.arange(n), mine) if mine >= 0 else np.arange(n)
        list_of, depth, more = np.arange(len(value))[:, None], 0, max(1, int(n * FIRST))
        while depth < n and len(alive) > FEW * k and len(value):
            to = min(n, depth + more)
            rows = np.concatenate([self.rows[up, n - to : n - depth], self.rows[down, depth:to]])
            gain = np.concatenate([self.values[up, n - to : n - depth], self.values[down, depth:to]]) * value
            if kind is np.float64:
                part += np.bincount(rows.ravel(), gain.ravel(), n)
            else:
                np.add.at(part, rows.ravel(), gain.ravel())
            met[list_of, rows] = 1
            self.read += rows.size
            depth, more = to, to
            frontier = np.append(self.values[up, n - to], self.values[down, to - 1]).astype(kind) * value[:, 0]
            bounds = np.stack([worst, frontier])
            lower, upper = (part + bounds.sum(axis=1)[:, None] - bounds @ met)[:, alive]
            alive = alive[upper >= max(known, np.partition(lower, len(lower) - k)[len(lower) - k])]
        return alive

    def best(self, ids: np.ndarray, query: np.ndarray, mine: int, k: int, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best, none of them below `known` left out."""
        rows = self.candidates(query, mine, k, known)
        score = self.vectors[rows].astype(np.int64) @ query.astype(np.int64)
        first = np.lexsort((ids[rows], -score))[:k]
        return rows[first], score[first]


def _bytes(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them all."""
    low, high = int(numbers.min(initial=0)), int(numbers.max(initial=0))
    return numbers.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _numbers(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (n * dim)}").reshape(n, dim)


PACKED = "block long, dim long, n long, ids binary, data binary"


def packed(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of vec_ids and integer vectors of one length."""

    def rows(it):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}

        def emit(dim: int):
            nonlocal serial
            own = waiting.pop(dim)
            ids, data = (np.concatenate([x[i] for x in own]) for i in (0, 1))
            for at in range(0, len(ids), block):
                part = ids[at : at + block]
                serial += 1
                yield pa.record_batch({"block": [serial], "dim": [dim], "n": [len(part)], "ids": pa.array([part.tobytes()], pa.binary()), "data": pa.array([_bytes(data[at : at + block])], pa.binary())})

        for batch in it:
            lists = batch["embedding"]
            size = lists.value_lengths().fill_null(0).to_numpy()
            for dim in np.unique(size[size > 0]).tolist():
                own = np.flatnonzero(size == dim)
                values = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                ok = np.isfinite(values).all(axis=1)
                ids = batch["vec_id"].to_numpy(zero_copy_only=False)[own[ok]].astype(np.int64)
                if not len(ids):
                    continue
                waiting.setdefault(dim, []).append((ids, np.floor(SCALE * values[ok]).astype(np.int64)))
                if sum(len(x[0]) for x in waiting[dim]) >= block:
                    yield from emit(dim)
        for dim in list(waiting):
            yield from emit(dim)

    return vectors.where("vec_id is not null").mapInArrow(rows, PACKED)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block: int = BLOCK) -> DataFrame:
    """The k best rows for each query row (vec_id divisible by `every`): query_id, rank, vec_id, score."""
    spark = session(vectors)
    blocks = cut(packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), block))

    def asks(it):
        for batch in it:
            for b, dim, n, ids, data in zip(*(batch[c].to_pylist() for c in ("block", "dim", "n", "ids", "data")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                own = np.flatnonzero(ids % every == 0)
                if len(own):
                    yield pa.record_batch({"q_block": [b], "q_dim": [dim], "q_n": [len(own)], "q_ids": pa.array([ids[own].tobytes()], pa.binary()), "q_rows": pa.array([own.tobytes()], pa.binary()), "q_data": pa.array([_bytes(_numbers(data, n, dim)[own])], pa.binary())})

    queries = blocks.mapInArrow(asks, "q_block long, q_dim long, q_n long, q_ids binary, q_rows binary, q_data binary")
    # Each block is in one bucket and each query in all of them; buckets that are fewer than tasks are cut by queries as well.
    n_blocks, tasks = blocks.count(), partitions(spark)
    buckets = max(1, min(4 * tasks, n_blocks))
    shares = -(-2 * tasks // buckets)
    left = blocks.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("long")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(tasks, "dim", "bucket", "share")
    right = queries.withColumn("q_share", F.pmod(F.xxhash64("q_block"), F.lit(shares)).cast("int")).withColumn("q_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))).repartition(tasks, "q_dim", "q_bucket", "q_share")
    pairs = left.join(right.hint("merge"), (F.col("dim") == F.col("q_dim")) & (F.col("bucket") == F.col("q_bucket")) & (F.col("share") == F.col("q_share")))

    def search(it):
        at, lists = None, None
        known: dict[int, np.ndarray] = {}  # of each query met so far, a score that its k-th best reaches
        for batch in it:
            for x in batch.to_pylist():
                if at != x["block"]:
                    at, lists = x["block"], Lists(_numbers(x["data"], x["n"], x["dim"]))
                q = _numbers(x["q_data"], x["q_n"], x["dim"])
                ids, q_ids, q_rows = (np.frombuffer(x[c], np.int64) for c in ("ids", "q_ids", "q_rows"))
                own = q_rows if at == x["q_block"] else np.full(len(q), -1)
                floor = known.setdefault(x["q_block"], np.full(len(q), -np.inf))
                best = [lists.best(ids, one, mine, k, least) for one, mine, least in zip(q, own.tolist(), floor.tolist(), strict=True)]
                for i, (_, score) in enumerate(best):
                    if len(score) == k:
                        floor[i] = max(floor[i], score[-1])
                size = [len(r) for r, _ in best]
                yield pa.record_batch({
                    "q_block": pa.array(np.repeat(x["q_block"], sum(size))), "q_row": pa.array(np.repeat(q_rows, size)), "query_id": pa.array(np.repeat(q_ids, size)),
                    "vec_id": pa.array(ids[np.concatenate([r for r, _ in best])]), "score": pa.array(np.concatenate([s for _, s in best])),
                })

    found = pairs.select("block", "dim", "n", "ids", "data", "q_block", "q_n", "q_ids", "q_rows", "q_data").mapInArrow(search, "q_block long, q_row long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
