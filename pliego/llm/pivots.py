"""Exact top-k search by inner product with a table of pivot distances.

Every vector is kept with its distances to a few pivots. By the triangle inequality the largest difference between a query's
and a candidate's pivot distances is a lower bound of their distance, and with the lengths of both an upper bound of
their inner product. Candidates are evaluated in the order of that bound, and a query is done with a block when the next
bound is below its k-th best score so far.

The search stands still for the candidates: queries travel to the tasks in batches of a fixed size, each task hands on its
k best per query, and only those that reach a first threshold, the k-th best score among a sample of all vectors. The
driver holds one batch of queries at a time: its results are written and its broadcast is removed before the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from pliego.session import kept, shared_folder

SCALE = 64
PIVOTS = 16
SAMPLE = 4_096  # vectors from which pivots and first thresholds come; changes the speed, not the result
BATCH = 16_384  # queries per pass
QUERIES, CANDIDATES, FIRST = 512, 4_096, 64
NONE = -(1 << 63) + 1  # score of an empty place; its negative is a number, too
ROUNDING = 1e-10  # far above the rounding of 64-bit sums over as many components as a vector may have
MOST = 2.0**20  # components up to this are multiplied in floating point without rounding


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and whole components; vectors that are null or hold null, NaN or infinite components are left out."""
    x = F.col(vector).cast("array<double>")
    big = F.lit(float("inf"))
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("x")
    )


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of all rows; beyond 64 bits they wrap around."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= MOST and a.shape[1] < 1 << 12:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances to the pivots, from the differences themselves: close vectors lose no digits."""
    out = np.zeros((len(x), len(pivots)))
    x = x.astype(np.float64)
    for n, pivot in enumerate(pivots.astype(np.float64)):
        gap = x - pivot
        out[:, n] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other: each next one is the farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def bounds(q: np.ndarray, dq: np.ndarray, x: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries and candidates.

    A distance is off by ``ROUNDING`` of itself and of the lengths of its ends at most, whatever pivot it leads to; a pivot is no
    longer than a query and its distance to it together. The difference of two distances is lowered by that.
    """
    low = np.zeros((len(q), len(x)))
    for p in range(dq.shape[1]):
        gap = dq[:, p, None] - dx[None, :, p]
        np.maximum(low, np.abs(gap, out=gap), out=low)
    square = [(v.astype(np.float64) ** 2).sum(1) for v in (q, x)]
    off = [ROUNDING * (2 * np.sqrt(s) + 2 * d.max(1, initial=0)) for s, d in zip(square, (dq, dx))]
    low -= off[0][:, None] + off[1][None, :]
    length = square[0][:, None] + square[1][None, :]
    return (length - np.square(np.maximum(low, 0, out=low), out=low)) / 2 + ROUNDING * length + 1


class Best:
    """The k best (score, smaller id first) of each query of a batch."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.scores = np.full((n, k), NONE, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.floor, self.k, self.offered = floor, k, 0

    def least(self, rows: slice) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[row], scores]), np.concatenate([self.ids[row], ids])
        if scores.size > 4 * self.k:  # keep all ties of the k-th score
            near = scores >= np.partition(scores, scores.size - self.k)[scores.size - self.k]
            scores, ids = scores[near], ids[near]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[row], self.ids[row] = scores[order], ids[order]


def search_block(best: Best, rows: slice, q: np.ndarray, qid: np.ndarray, dq: np.ndarray, x: np.ndarray, xid: np.ndarray, dx: np.ndarray) -> int:
    """Evaluate a block of candidates for a block of queries; returns how many pairs were evaluated."""
    bound = bounds(q, dq, x, dx)
    bound[qid[:, None] == xid[None, :]] = -np.inf
    first = min(FIRST, len(x))
    lead = np.argpartition(-bound, first - 1, axis=1)[:, :first] if first < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
    done = 0
    rest = bound >= best.least(rows)[:, None]
    for i in np.flatnonzero(rest.any(1)):
        mine = lead[i][rest[i, lead[i]]]
        if mine.size:
            scores = _products(q[i : i + 1], x[mine])[0]
            good = scores >= best.least(rows)[i]
            best.offer(rows.start + i, scores[good], xid[mine[good]])
            done += mine.size
        rest[i, lead[i]] = False
    rest &= bound >= best.least(rows)[:, None]
    left = np.flatnonzero(rest.any(1))
    if left.size:
        columns = np.flatnonzero(rest[left].any(0))
        scores = _products(q[left], x[columns])
        good = rest[np.ix_(left, columns)] & (scores >= best.least(rows)[left][:, None])
        done += int(rest[left].sum())
        for j in np.flatnonzero(good.any(1)):
            best.offer(rows.start + left[j], scores[j, good[j]], xid[columns[good[j]]])
    return done


def top_k(vectors: DataFrame, queries, k: int = 20, vector: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of each query with all other rows: query_id, rank, vec_id, score.

    ``queries`` is a condition on vec_id that says which rows are queries. Ties go to the smaller vec_id. A row with the
    query's own id is no candidate; otherwise rows that share an id are candidates each, and queries that share an id are
    one query, that with the smallest components. Only vectors of equal length are compared. Extra columns are ignored.
    """
    store = vectors.select("vec_id", vector) if vector in vectors.columns else vectors
    rows = kept(quantised(store, vector).withColumn("n", F.size("x")), "quantised")
    asked = rows.filter(queries).groupBy("vec_id", "n").agg(F.min("x").alias("x"))
    spark = vectors.sparkSession
    sizes = asked.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / BATCH).cast("int").alias("batches"))
    groups = sizes.collect()  # one row per vector length
    blocks, results = shared_folder(spark, "query-batches"), shared_folder(spark, "best")
    asked = asked.join(F.broadcast(sizes), "n").withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.col("batches")).cast("int"))
    asked.repartition("n", "batch").write.partitionBy("n", "batch").parquet(blocks)
    asked = spark.read.schema(asked.schema).parquet(blocks)
    for g in groups:
        of_length = F.col("n") == g["n"]
        sample = rows.filter(of_length).orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).select("vec_id", "x").toArrow()
        for batch in range(g["batches"]):
            _search(rows.filter(of_length), asked.filter(of_length & (F.col("batch") == batch)), sample, k, results)
    schema = "query_id bigint, vec_id bigint, score bigint"
    every = spark.read.schema(schema).parquet(results) if groups else spark.createDataFrame([], schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(column), 0), np.int64)


def _search(rows: DataFrame, asked: DataFrame, sample: pa.Table, k: int, results: str) -> None:
    """One pass: the results of a batch of queries against all rows of their length are added to the folder."""
    mine = asked.select("vec_id", "x").orderBy("vec_id").toArrow()
    width = len(sample["x"][0]) if sample.num_rows else 0
    q, s = (_matrix(t["x"].combine_chunks(), width) for t in (mine, sample))
    qid, sid = mine["vec_id"].to_numpy(), sample["vec_id"].to_numpy()
    pivots = choose_pivots(s)
    floor = np.full(len(q), NONE, np.int64)
    for at in range(0, len(q), QUERIES):
        if len(np.unique(sid)) == len(sid) > k:
            scores = _products(q[at : at + QUERIES], s)
            scores[qid[at : at + QUERIES, None] == sid[None, :]] = NONE
            floor[at : at + QUERIES] = np.partition(scores, len(sid) - k, axis=1)[:, len(sid) - k]
    shared = rows.sparkSession.sparkContext.broadcast((q, qid, pivots, floor, distances(q, pivots)))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qid, pivots, floor, dq = shared.value
        best = Best(len(q), k, floor)

        def visit(x: np.ndarray, xid: np.ndarray) -> None:
            dx = distances(x, pivots)
            order = np.lexsort((dx.min(1), dx.argmin(1)))  # neighbours together, so that blocks are left out whole
            x, xid, dx = x[order], xid[order], dx[order]
            for a in range(0, len(x), CANDIDATES):
                for b in range(0, len(q), QUERIES):
                    c, r = slice(a, a + CANDIDATES), slice(b, min(b + QUERIES, len(q)))
                    search_block(best, r, q[r], qid[r], dq[r], x[c], xid[c], dx[c])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in parts:
            if part.num_rows:
                held.append((_matrix(part.column("x"), q.shape[1]), part.column("vec_id").to_numpy()))
            if sum(len(i) for _, i in held) >= 8 * CANDIDATES:
                visit(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            visit(*map(np.concatenate, zip(*held)))
        row, place = np.nonzero(best.ids < np.iinfo(np.int64).max)
        yield pa.record_batch(
            [pa.array(qid[row]), pa.array(best.ids[row, place]), pa.array(best.scores[row, place])], names=["query_id", "vec_id", "score"]
        )

    found = rows.select("vec_id", "x").mapInArrow(scan, "query_id bigint, vec_id bigint, score bigint")
    found.write.mode("append").parquet(results)
    shared.destroy()
