"""Exact nearest neighbours of many queries: L2 distance compared at six decimals, ties by id.

Queries and store both stay tables. Each is cut into blocks of bounded bytes, and every block of queries meets every block of
the store in one cell of a grid, which is one group of a cogroup: a task holds two blocks, whatever the tables' sizes are.
A cell gives the best rows of its block per query; the lists of a query are merged in a tree, a bounded number of
blocks at a time. With a filter the grid exists once per filter value, so only rows of equal values meet: a value with many
rows is many cells, and values with few rows share one. Nothing but sizes goes through the driver, and the number of
jobs does not depend on the number of queries.

Without a filter, all but a small store is first searched for distances only in a quarter of its rows, by the same way. The last
distance there is one beyond which no row is of use, so all cells together give a few times the rows a query wants, however many
blocks the store has. Of a large store it is a sixteenth of the rows, and a distance that is very likely enough; the
few queries for which it is not are searched again without it.

A row of either side is copied once per block of the other one, so the blocks are as large as a task can hold, and are cut further
for more cells where that copies the fewest bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from pliego import constants as K
from pliego.functions.vectors import as_matrix
from pliego.session import kept

QUERY_BYTES, STORE_BYTES = 32 << 20, 64 << 20  # vectors of a block of the grid, at most
SHARED_BYTES = 1 << 19  # of the filter values that share a cell, on average
LEAST_BYTES = 1 << 18  # blocks are cut down to this, so that all cores have a cell
DIRECT, SHARE = 0.25, 4  # blocks of a store that is searched at once; else one of so many rows is searched first
LARGE_BYTES, LARGE_SHARE = 128 << 20, 16  # of a store of more bytes, one of so many rows
BRANCH = 64  # lists of a query that are merged at once
BLOCK_ROWS = 1024
BLOCK_QUERIES = 2048
STRIP = 256  # queries of a block whose products with the rows of a block stay in a core's cache
MICRO = 1e6

CELL = ["alone", "cell", "q", "s"]
LISTS = ["chunk_id", "distance", "similarity"]
HIT = "query_id bigint, k int, fetch int, s int, chunk_id array<bigint>, distance array<double>, similarity array<double>"
HIT_FIELDS = pa.schema([
    ("query_id", pa.int64()), ("k", pa.int32()), ("fetch", pa.int32()), ("s", pa.int32()), ("chunk_id", pa.list_(pa.int64())),
    ("distance", pa.list_(pa.float64())), ("similarity", pa.list_(pa.float64())),
])
NEAR = "query_id bigint, fetch int, distance array<float>"
NEAR_FIELDS = pa.schema([("query_id", pa.int64()), ("fetch", pa.int32()), ("distance", pa.list_(pa.float32()))])
EXACT_PAIRS = 1 << 14  # pairs whose distance is taken at once


def fetch_size(k: Column) -> Column:
    """Candidates for k results, so that re-ranking has a choice."""
    return F.greatest(K.FETCH_FACTOR * k, F.lit(K.MIN_FETCH)).cast("int")


@dataclass
class Side:
    """Rows of one filter value, in id order. ``about`` has the columns only queries have: reach, k and fetch."""

    ids: np.ndarray
    vectors: np.ndarray
    about: dict[str, np.ndarray]

    @staticmethod
    def by_part(table: pa.Table, id_name: str) -> dict[int, Side]:
        ids, parts = np.asarray(table.column(id_name)), np.asarray(table.column("part"))
        vectors = as_matrix(table.column("vec"), None)
        about = {n: np.asarray(table.column(n)) for n in ("reach", "k", "fetch") if n in table.schema.names}
        order = np.lexsort((ids, parts))
        found, starts = np.unique(parts[order], return_index=True)
        cuts = np.split(order, starts[1:])
        return {int(p): Side(ids[c], vectors[c], {n: v[c] for n, v in about.items()}) for p, c in zip(found, cuts)}

    @property
    def reach(self) -> np.ndarray:
        return self.about["reach"]

    @cached_property
    def squares(self) -> np.ndarray:
        return (self.vectors.astype(np.float64) ** 2).sum(axis=1)

    def blocks(self, size: int) -> Iterator[Side]:
        for at in range(0, len(self.ids), size):
            cut = slice(at, at + size)
            yield Side(self.ids[cut], self.vectors[cut], {n: v[cut].copy() for n, v in self.about.items()})


def factors(vectors: np.ndarray, squares: np.ndarray, asking: bool) -> np.ndarray:
    """Two more columns, so that the product of queries and rows is their squared distance; what is taken from a query's
    ``squares`` is taken from its products."""
    out = np.empty((len(vectors), vectors.shape[1] + 2), vectors.dtype)
    np.multiply(vectors, -2 if asking else 1, out=out[:, :-2])
    out[:, -1 if asking else -2] = 1
    out[:, -2 if asking else -1] = squares
    return out


def square_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The product of queries and rows, both with the columns of ``factors``."""
    return left @ right.T


def first_of_each(groups: np.ndarray, k: int) -> np.ndarray:
    """Mask of the first ``k`` entries of each run of equal values."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)])) < k


def exact_squares(left: np.ndarray, right: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Squared distances of the given pairs in double precision."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), EXACT_PAIRS):
        cut = slice(at, at + EXACT_PAIRS)
        apart = left[rows[cut]].astype(np.float64) - right[columns[cut]]
        out[cut] = np.einsum("ij,ij->i", apart, apart)
    return out


def best_pairs(queries: Side, store: Side, k: int, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, store position, squared distance) of each query's ``k`` best rows within its reach, the rows of
    a query in the order of their ids. ``full`` queries have k rows with smaller ids within their reach.

    The product of the two blocks, in the vectors' own precision, only says which pairs may be near enough: its rounding is
    allowed for, and the distances of those pairs are taken directly. What a query can do with is part of the product, so
    its sign tells; products are made a strip at a time, and nothing else is done with those of most pairs."""
    left, right = queries.vectors, store.vectors
    width, largest = left.shape[1], store.squares.max(initial=0)
    if not max(queries.squares.max(initial=0), largest) < 1e30:
        left, right = left.astype(np.float64), right.astype(np.float64)  # squares may pass the range of single precision
    most = np.finfo(left.dtype).max / 4
    room = 4 * (width + 8) * np.finfo(left.dtype).eps * (queries.squares + largest)
    right = factors(right, store.squares, False)
    limit = (queries.reach + 2 / MICRO) ** 2 + room
    open_ = np.flatnonzero(np.isinf(limit))
    if len(open_) and k < len(store.ids):
        squares = square_distances(factors(left[open_], queries.squares[open_], True), right)
        least = np.maximum(np.partition(squares, k - 1, axis=1)[:, k - 1], 0)
        limit[open_] = least + 2 * room[open_] + 8 / MICRO * (1 + np.sqrt(largest))
    limit[full & (queries.reach <= 0)] = -np.inf  # copies with larger ids change nothing
    left = factors(left, np.clip(queries.squares - limit, -most, most), True)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(left), STRIP):
        beyond = square_distances(left[at : at + STRIP], right)
        some = np.flatnonzero(beyond.min(axis=1, initial=np.inf) <= 0)
        if len(some):
            rows, columns = np.divmod(np.flatnonzero(beyond[some] <= 0), len(right))
            found.append((some[rows] + at, columns))
    rows, columns = (np.concatenate(c) for c in zip(*found))
    near = exact_squares(queries.vectors, store.vectors, rows, columns)
    within = np.sqrt(near) <= queries.reach[rows] + 2 / MICRO
    rows, columns, near = rows[within], columns[within], near[within]
    if np.bincount(rows, minlength=1).max() > k:
        order = np.lexsort((columns, np.rint(np.sqrt(near) * MICRO), rows))
        order = order[first_of_each(rows[order], k)]
        order = order[np.lexsort((columns[order], rows[order]))]
        rows, columns, near = rows[order], columns[order], near[order]
    return rows, columns, near


class Best:
    """The best rows so far of some queries, in (query, distance, id) order, and the rows found since they were sorted."""

    def __init__(self, queries: Side):
        self.queries, self.k = queries, int(queries.about["fetch"].max())
        self.rows, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.distance, self.similarity = np.zeros(0), np.zeros(0)
        self.new: list[tuple[np.ndarray, ...]] = []

    def take(self, store: Side) -> None:
        rows, columns, near = best_pairs(self.queries, store, self.k, self.counts() >= self.k)
        mine, theirs = self.queries.squares[rows], store.squares[columns]
        norms = np.sqrt(mine * theirs)
        similarity = (mine + theirs - near) / np.where(norms == 0, 1, 2 * norms)
        self.new.append((rows, store.ids[columns], np.round(np.sqrt(near), 6), similarity))
        if sum(len(n[0]) for n in self.new) >= len(self.rows):
            self.settle()

    def settle(self) -> None:
        old = (self.rows, self.ids, self.distance, self.similarity)
        rows, ids, distance, similarity = (np.concatenate(c) for c in zip(old, *self.new))
        self.new = []
        # stable: equal distances stay in the order of their ids, since blocks come in that order
        order = np.lexsort((distance, rows.astype(np.min_scalar_type(len(self.queries.ids)))))
        order = order[first_of_each(rows[order], self.k)] if len(order) else order
        self.rows, self.ids, self.distance, self.similarity = rows[order], ids[order], distance[order], similarity[order]
        ends = np.cumsum(self.counts())
        full = self.counts() >= self.k
        self.queries.reach[full] = np.minimum(self.queries.reach[full], self.distance[ends[full] - 1])

    def counts(self) -> np.ndarray:
        return np.bincount(self.rows, minlength=len(self.queries.ids))

    def hits(self, s: int) -> pa.RecordBatch:
        """One row with three lists per query that found something."""
        self.settle()
        counts, of = self.counts(), self.queries
        some = np.flatnonzero(counts)
        ends = pa.array(np.r_[0, np.cumsum(counts[some])].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (self.ids, self.distance, self.similarity)]
        columns = [of.ids[some], of.about["k"][some], of.about["fetch"][some], np.full(len(some), s, np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], schema=HIT_FIELDS)

    def distances(self) -> pa.RecordBatch:
        """One row with the distances, rounded up to single precision, per query that found something."""
        self.settle()
        counts, of = self.counts(), self.queries
        some = np.flatnonzero(counts)
        ends = pa.array(np.r_[0, np.cumsum(counts[some])].astype(np.int32))
        with np.errstate(over="ignore"):  # what passes single precision is no bound
            above = np.nextafter(self.distance.astype(np.float32), np.float32(np.inf))
        columns = [pa.array(of.ids[some]), pa.array(of.about["fetch"][some]), pa.ListArray.from_arrays(ends, pa.array(above))]
        return pa.RecordBatch.from_arrays(columns, schema=NEAR_FIELDS)


def best_of_cell(left: pa.Table, right: pa.Table) -> Iterator[Best]:
    """The best of the store's rows ``right`` for the queries ``left`` with equal filter values, some queries at a time."""
    if left.num_rows and right.num_rows:
        stored = Side.by_part(right, "chunk_id")
        for part, asked in Side.by_part(left, "query_id").items():
            blocks = list(stored[part].blocks(BLOCK_ROWS)) if part in stored else []
            for some in asked.blocks(BLOCK_QUERIES) if blocks else ():
                best = Best(some)
                for block in blocks:
                    best.take(block)
                yield best


def meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best rows of one cell."""
    return pa.Table.from_batches([best.hits(right.column("s")[0].as_py()) for best in best_of_cell(left, right)], HIT_FIELDS)


def meet_near(left: pa.Table, right: pa.Table) -> pa.Table:
    """The distances of the best rows of one cell."""
    return pa.Table.from_batches([best.distances() for best in best_of_cell(left, right)], NEAR_FIELDS)


def shape(asked_bytes: int, rows_bytes: int, cells: int) -> tuple[int, int]:
    """Blocks of queries and of the store: as few as their bounds allow, then more, up to so many cells, where a cell
    copies fewer bytes of the other side."""
    q_n, s_n = -(-max(asked_bytes, 1) // QUERY_BYTES), -(-max(rows_bytes, 1) // STORE_BYTES)
    while q_n * s_n < cells:
        ways = []
        if q_n < asked_bytes // LEAST_BYTES:
            ways.append((rows_bytes / s_n, q_n + 1, s_n))
        if s_n < rows_bytes // LEAST_BYTES:
            ways.append((asked_bytes / q_n, q_n, s_n + 1))
        if not ways:
            break
        _, q_n, s_n = min(ways)
    return q_n, s_n


def grid(asked: DataFrame, rows: DataFrame, parted: bool, asked_bytes: int, rows_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell (part or group of parts, q, s) in which each copy of a row meets the other side."""

    def blocks(size, limit: int) -> Column:
        return F.ceil(F.greatest(size, F.lit(1)) / F.lit(limit)).cast("int")

    def spread(side: DataFrame, own: str, other: str, key: str) -> DataFrame:
        """A row's own block by its id, and a copy for each block of the other side."""
        return side.withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}_n")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_n") - 1))
        )

    if parted:
        sizes = asked.groupBy("part").agg(F.sum(bytes_of("vec")).alias("a")).join(rows.groupBy("part").agg(F.sum(bytes_of("vec")).alias("b")), "part")
        sizes = sizes.select("part", blocks(F.col("a"), QUERY_BYTES).alias("q_n"), blocks(F.col("b"), STORE_BYTES).alias("s_n"))
        many = F.col("q_n") * F.col("s_n") > 1
        groups = (asked_bytes + rows_bytes) // SHARED_BYTES + 1
        sizes = sizes.withColumns({"alone": many, "cell": F.when(many, F.col("part")).otherwise(F.pmod(F.xxhash64("part"), F.lit(groups)))})
        asked, rows = asked.join(sizes, "part"), rows.join(sizes, "part")
    else:
        q_n, s_n = shape(asked_bytes, rows_bytes, cells_of(asked))
        n = {"q_n": q_n, "s_n": s_n}
        own = {**{k: F.lit(v) for k, v in n.items()}, "alone": F.lit(True), "cell": F.lit(0).cast("bigint")}
        asked, rows = asked.withColumns(own), rows.withColumns(own)
    cell = [F.col(c).alias(c) for c in CELL]  # new columns on either side, where both have those of the sizes
    left = spread(asked, "q", "s", "query_id").select("query_id", "vec", "part", "reach", "k", "fetch", *cell)
    return left, spread(rows, "s", "q", "chunk_id").select("chunk_id", "vec", "part", *cell)


def bytes_of(vector: str) -> Column:
    return F.size(vector).cast("bigint") * 4


def merged(hits: DataFrame, most: int, lists: int) -> DataFrame:
    """The best ``fetch`` rows of each query with their rank, out of its lists by block."""
    order = [F.col("distance"), F.col("chunk_id")]
    while lists > BRANCH:
        hits = hits.withColumn("s", F.expr(f"s div {BRANCH}").cast("int"))
        place = F.row_number().over(W.partitionBy("query_id", "s").orderBy(*order))
        hits, lists = hits.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place"), -(-lists // BRANCH)
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.filter("rank <= fetch").select("query_id", "k", "rank", "chunk_id", "distance", "similarity", "fetch")


def cells_of(asked: DataFrame) -> int:
    """Cells that keep all cores busy."""
    return 2 * asked.sparkSession.sparkContext.defaultParallelism


def met(asked: DataFrame, rows: DataFrame, parted: bool, asked_bytes: int, rows_bytes: int) -> DataFrame:
    """(query_id, k, fetch, s, chunk_id, distance, similarity): the best rows of every cell. A query's lists are moved
    as they are and opened where they are merged."""
    one, other = (side.groupBy(*CELL) for side in grid(asked, rows, parted, asked_bytes, rows_bytes))
    lists = one.cogroup(other).applyInArrow(meet, HIT).repartition("query_id")
    return lists.select("query_id", "k", "fetch", "s", F.inline(F.arrays_zip(*LISTS)))


def within(asked: DataFrame, last: DataFrame) -> DataFrame:
    """The queries with the last distance as their reach, where that is nearer."""
    return asked.join(last, "query_id", "left").withColumn("reach", F.least("reach", "_last")).drop("_last")


def last_distances(asked: DataFrame, rows: DataFrame, asked_bytes: int, rows_bytes: int, level: int = 0, share: int = SHARE) -> DataFrame:
    """(query_id, _last): the distance of the last result a query wants, in a part of the rows. Null if the part has fewer
    within the query's reach. A large part is searched in the same way, within the last distances of a part of it."""
    some = rows.filter(F.pmod(F.xxhash64("chunk_id", F.lit(level)), F.lit(share)) == 0)
    size = rows_bytes // share
    if size > DIRECT * STORE_BYTES:
        asked = within(asked, last_distances(asked, some, asked_bytes, size, level + 1))
    one, other = (side.groupBy(*CELL) for side in grid(asked, some, False, asked_bytes, size))
    lists = one.cogroup(other).applyInArrow(meet_near, NEAR)
    together = lists.groupBy("query_id").agg(F.max("fetch").alias("fetch"), F.sort_array(F.flatten(F.collect_list("distance"))).alias("near"))
    return kept(together.select("query_id", F.get("near", F.col("fetch") - 1).cast("double").alias("_last")), "last")


def likely(fetch: Column, share: int) -> Column:
    """As many of one of ``share`` rows as are very unlikely to be among the ``fetch`` nearest of all rows."""
    mean = fetch / F.lit(share)
    return F.least(fetch, F.ceil(mean + 5 * F.sqrt(mean) + 6)).cast("int")


def best_of(asked: DataFrame, rows: DataFrame, parted: bool, asked_bytes: int, rows_bytes: int, most: int) -> DataFrame:
    """The merged rows of all cells; those of all but a small store within the last distances in a part of it.

    Of a large store the part is small, and the distance is one within which the part has more rows than it should have among
    the results. Queries with too few rows within it are searched again without it."""

    def all_of(asked: DataFrame, asked_bytes: int) -> DataFrame:
        lists = -(-rows_bytes // STORE_BYTES) if parted else shape(asked_bytes, rows_bytes, cells_of(asked))[1]
        return merged(met(asked, rows, parted, asked_bytes, rows_bytes), most, lists)

    if parted or rows_bytes <= DIRECT * STORE_BYTES:
        return all_of(asked, asked_bytes)
    if rows_bytes <= LARGE_BYTES:
        return all_of(within(asked, last_distances(asked, rows, asked_bytes, rows_bytes)), asked_bytes)
    fewer = asked.withColumn("fetch", likely(F.col("fetch"), LARGE_SHARE))
    last = last_distances(fewer, rows, asked_bytes, rows_bytes, share=LARGE_SHARE)
    best = kept(all_of(within(asked, last), asked_bytes), "best")
    last = last.filter("_last is not null")
    sure = best.join(last, "query_id").filter(F.col("distance") <= F.col("_last") + 1 / MICRO)
    got = sure.groupBy("query_id").agg(F.count(F.lit(1)).alias("_got"))
    bound = asked.select("query_id", "fetch", "reach").join(last, "query_id").filter("_last < reach").join(got, "query_id", "left")
    short = kept(asked.join(bound.filter("coalesce(_got, 0) < fetch"), "query_id", "left_semi"), "short")
    left = short.agg(F.sum(bytes_of("vec")).alias("n")).first().n
    if not left:
        return best
    return best.join(short, "query_id", "left_anti").unionByName(all_of(short, left))


def nearest(
    queries: DataFrame,
    store: DataFrame,
    fetch: Column,
    same: tuple[str, str] | None = None,
    vectors: bool = False,
    reach: Column | None = None,
) -> DataFrame:
    """(query_id, k, rank, chunk_id, distance, similarity): the ``fetch`` nearest store rows per query, on demand with
    their ``embedding``.

    ``same`` names an integer column of either side that has to be equal; a query may have a row for each of several values.
    ``reach`` is a distance beyond which a query wants nothing. Queries without a vector find nothing. Queries and store are
    read twice, once for their sizes, so a caller keeps them if they are expensive to make."""
    left, right = same or (None, None)
    if same:
        queries, store = queries.filter(F.col(left).isNotNull()), store.filter(F.col(right).isNotNull())
    asked = queries.filter("query_vec is not null").select(
        "query_id",
        F.col("query_vec").alias("vec"),
        (F.col(left) if left else F.lit(0)).cast("bigint").alias("part"),
        (F.lit(float("inf")) if reach is None else reach).cast("double").alias("reach"),
        F.col("k").cast("int").alias("k"),
        fetch.cast("int").alias("fetch"),
    )
    rows = store.filter("embedding is not null").select(
        "chunk_id",
        F.col("embedding").alias("vec"),
        (F.col(right) if right else F.lit(0)).cast("bigint").alias("part"),
    )
    told = asked.agg(F.sum(bytes_of("vec")).alias("n"), F.max("fetch").alias("most")).first()
    size = rows.agg(F.sum(bytes_of("vec")).alias("n")).first().n or 0
    best = best_of(asked, rows, same is not None, told.n or 0, size, told.most or 0).drop("fetch")
    if vectors:
        best = kept(best, "nearest")  # the copies on the grid go before vectors are moved
        best = rows.select("chunk_id", F.col("vec").alias("embedding")).join(best, "chunk_id")
    return best


def answerable(queries: DataFrame, store: DataFrame) -> DataFrame:
    """query_id and whether a search would find anything: whether the store has any vector of the query's length. One row
    per length meets the queries; nothing is searched."""
    widths = store.filter("embedding is not null").select(F.size("embedding").alias("_width")).distinct().withColumn("_any", F.lit(True))
    met = queries.join(widths, F.size("query_vec") == F.col("_width"), "left")
    return met.select("query_id", F.coalesce("_any", F.lit(False)).alias("answerable"))
