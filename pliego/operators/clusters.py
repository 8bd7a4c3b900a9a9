"""A clustered index for exact search: each query reads only the cells that can hold one of its nearest rows.

The store is written in cells, one Parquet partition each, around k-means centres. A cell knows its size and the least and
largest distance of its rows to the centre, so by the triangle inequality no row of it is nearer to a query than
``max(d - largest, least - d)``, where d is the query's distance to the centre. A query first searches its *home*, the
nearest centres' cells that together hold as many rows as it wants. The last of those is its reach; then it searches the other cells whose
bound is within reach. The result is that of a full search. Where the bounds spare little, so that a query would be copied to
very many cells, the reach of the home goes into the grid over all rows instead, whose copies do not grow with the cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pliego.functions.vectors import as_matrix
from pliego.operators.nearest import factors, merged, nearest, square_distances
from pliego.session import kept, shared_folder

CELL_ROWS = 512  # rows a cell holds on average, as long as there are fewer than ...
MOST_CELLS = 1024  # ... so many cells: their centres travel with the tasks
MOST_VISITS = 32  # cells outside its home that a query is copied to on average; beyond that, all rows meet on the grid
PART = 256  # rows whose distances to all centres are held at once
ROUNDS = 5
CHOICE = 4  # rows that each first centre is chosen from, on average
SUMS = 16  # groups in which the tasks' sums are added
SLACK = 4e-6  # distances are compared at six decimals


@dataclass
class Index:
    """``rows``: chunk_id, embedding, cell. The arrays have one entry per cell."""

    rows: DataFrame
    numbers: np.ndarray
    centres: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    largest: np.ndarray


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    left, right = (factors(side, (side**2).sum(axis=1), asking) for side, asking in ((vectors, True), (centres, False)))
    return np.sqrt(np.maximum(square_distances(left, right), 0))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def first_centres(rows: DataFrame, wanted: int) -> np.ndarray:
    """So many of a few times as many rows, each the farther from those before it the likelier (k-means++)."""
    some = rows.select("embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(CHOICE * wanted).toArrow()
    points, rng = as_matrix(some.column("embedding")), np.random.default_rng(1)
    chosen, away = [0], np.full(len(points), np.inf)
    while len(chosen) < wanted:
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        total = np.cumsum(away)
        if not total[-1] > 0:
            break  # all are copies of those that were chosen
        chosen.append(min(int(np.searchsorted(total, rng.random() * total[-1], side="right")), len(points) - 1))
    return points[chosen]


def means(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The mean of the rows nearest to each centre, of all rows; a centre without rows stays. A task gives one sum per centre, and
    the tasks' sums are added before they meet the driver."""
    right = factors(centres, (centres**2).sum(axis=1), False).astype(np.float32)

    def summed(batches):
        sums, counts = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for batch in parts(batches):
            vectors = as_matrix(batch.column("embedding"), np.float32)
            near = square_distances(factors(vectors, (vectors**2).sum(axis=1), True), right).argmin(axis=1)
            order = np.argsort(near, kind="stable")
            cells, starts, n = np.unique(near[order], return_index=True, return_counts=True)
            sums[cells] += np.add.reduceat(vectors[order].astype(np.float64), starts, axis=0)
            counts[cells] += n
        yield told(np.flatnonzero(counts), sums, counts)

    def added(table: pa.Table) -> pa.Table:
        cells, which = np.unique(np.asarray(table.column("cell")), return_inverse=True)
        sums, counts = np.zeros((len(cells), centres.shape[1])), np.zeros(len(cells), np.int64)
        np.add.at(sums, which, as_matrix(table.column("sum")))
        np.add.at(counts, which, np.asarray(table.column("n")))
        return pa.Table.from_batches([told(np.arange(len(cells)), sums, counts).set_column(0, "cell", pa.array(cells.astype(np.int32)))])

    def told(cells: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ends = pa.array((np.arange(len(cells) + 1) * sums.shape[1]).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(sums[cells].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), lists, pa.array(counts[cells])], names=["cell", "sum", "n"])

    form = "cell int, sum array<double>, n bigint"
    each = rows.mapInArrow(summed, form).groupBy(F.col("cell") % SUMS).applyInArrow(added, form).toArrow()
    out, cells = centres.copy(), np.asarray(each.column("cell"))
    if len(cells):
        out[cells] = as_matrix(each.column("sum")) / np.asarray(each.column("n"))[:, None]
    return out


def build(store: DataFrame, cell_rows: int = CELL_ROWS, most: int = MOST_CELLS) -> Index:
    """Writes the rows (chunk_id, embedding) of a store by cell; rows without a vector are in no cell.

    K-means places the centres over all rows. A cell with very many rows is several files, since the rebalance hint lets
    adaptive execution split it."""
    rows = store.filter("embedding is not null").select("chunk_id", "embedding")
    wanted = min(most, -(-rows.count() // cell_rows))
    if not wanted:
        nothing = np.zeros(0)
        return Index(rows.withColumn("cell", F.lit(0)), nothing, np.zeros((0, 0)), nothing, nothing, nothing)
    centres = first_centres(rows, wanted)
    for _ in range(ROUNDS):
        centres = means(rows, centres)

    def assign(batches):
        for batch in parts(batches):
            away = _distances(as_matrix(batch.column("embedding")), centres)
            cell = away.argmin(axis=1)
            columns = [batch.column("chunk_id"), batch.column("embedding"), pa.array(away[np.arange(len(cell)), cell]), pa.array(cell.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "embedding", "away", "cell"])

    path = shared_folder(store.sparkSession, "cells")
    dealt = rows.mapInArrow(assign, "chunk_id bigint, embedding array<float>, away double, cell int")
    dealt.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    written = store.sparkSession.read.schema(dealt.schema).parquet(path)
    about = written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("largest"))
    told = about.orderBy("cell").toArrow()  # a row per cell
    numbers, sizes, least, largest = (np.asarray(told[c]) for c in ("cell", "n", "least", "largest"))
    return Index(written.drop("away"), numbers, centres[numbers], sizes, least, largest)


def homes(away: np.ndarray, sizes: np.ndarray, fetch: np.ndarray) -> np.ndarray:
    """Mask (queries, cells) of the nearest centres whose cells together hold ``fetch`` rows."""
    order = np.argsort(away, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    out = np.zeros(away.shape, bool)
    np.put_along_axis(out, order, before < fetch[:, None], axis=1)
    return out


def others(index: Index, away: np.ndarray, norms: np.ndarray, home: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Mask of the cells outside the home whose lower bound is within reach."""
    bound = np.maximum(away - index.largest[None, :], index.least[None, :] - away)
    room = SLACK * (1 + norms[:, None] + np.sqrt((index.centres**2).sum(axis=1))[None, :])
    return ~home & (bound <= reach[:, None] + room)


def _chosen(index: Index, second: bool):
    """A function that gives the queries of a batch, a part at a time, with the mask of the cells they have to read."""
    known = Index(None, index.numbers, index.centres, index.sizes, index.least, index.largest)

    def choose(batches):
        for batch in parts(batches):
            vectors = as_matrix(batch.column("query_vec"))
            away = _distances(vectors, known.centres)
            mask = homes(away, known.sizes, np.asarray(batch.column("fetch")))
            if second:
                mask = others(known, away, np.sqrt((vectors**2).sum(axis=1)), mask, np.asarray(batch.column("reach")))
            yield batch, mask

    return choose, known.numbers


def visits(queries: DataFrame, index: Index, second: bool) -> DataFrame:
    """(query_id, query_vec, k, fetch, reach, cell): a row for each cell a query has to read, in its home or, with
    ``second``, outside of it."""
    choose, numbers = _chosen(index, second)

    def listed(batches):
        for batch, mask in choose(batches):
            at, cell = np.nonzero(mask)
            for some in range(0, len(at), 16 * PART):
                cut = slice(some, some + 16 * PART)
                yield batch.take(pa.array(at[cut])).append_column("cell", pa.array(numbers[cell[cut]].astype(np.int32)))

    return queries.mapInArrow(listed, "query_id bigint, query_vec array<float>, k int, fetch int, reach double, cell int")


def mean_visits(queries: DataFrame, index: Index) -> float:
    """Cells outside its home that a query has to read on average."""
    choose, _ = _chosen(index, True)

    def counted(batches):
        for batch, mask in choose(batches):
            yield pa.RecordBatch.from_arrays([pa.array(mask.sum(axis=1).astype(np.int64))], names=["n"])

    return queries.mapInArrow(counted, "n bigint").agg(F.avg("n").alias("n")).first().n or 0.0


def _read(index: Index, visit: DataFrame) -> DataFrame:
    """The partitions of the cells that are visited at all."""
    cells = [r.cell for r in visit.select("cell").distinct().collect()]  # at most MOST_CELLS numbers
    return index.rows.filter(F.col("cell").isin(cells))


def search(queries: DataFrame, index: Index, fetch: Column) -> DataFrame:
    """The rows of ``nearest(queries, store, fetch)``, where ``fetch`` depends on k alone."""
    asked = queries.filter("query_vec is not null").select(
        "query_id", "query_vec", F.col("k").cast("int").alias("k"), fetch.cast("int").alias("fetch"), F.lit(float("inf")).alias("reach")
    )
    if not len(index.numbers):
        return nearest(queries, index.rows, fetch)
    home = kept(visits(asked, index, False), "home")
    first = kept(nearest(home, _read(index, home), F.col("fetch"), ("cell", "cell")), "first")
    reached = first.groupBy("query_id").agg(F.max("distance").alias("far"))
    far = asked.drop("reach").join(reached, "query_id").withColumnRenamed("far", "reach")
    if mean_visits(far, index) > MOST_VISITS:
        return nearest(far, index.rows, F.col("fetch"), reach=F.col("reach"))
    away = kept(visits(far, index, True), "away")
    rest = nearest(away, _read(index, away), F.col("fetch"), ("cell", "cell"), reach=F.col("reach"))
    both = first.unionByName(rest).withColumn("fetch", fetch.cast("int")).withColumn("s", F.lit(0))
    most = asked.agg(F.max("fetch").alias("most")).first().most or 0
    return merged(both, most, 1).drop("fetch")
