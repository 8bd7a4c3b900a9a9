import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pliego.operators import nearest as N
from pliego.operators import rerank
from pliego.functions.vectors import as_matrix
from pliego.operators.nearest import fetch_size, nearest


def points(seed, n, dim=6, copies=0.35):
    """Clustered points; a third of them are the same point."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    p = centres[rng.integers(0, 5, n)] + 0.1 * rng.normal(size=(n, dim))
    p[rng.random(n) < copies] = centres[0]
    return p.astype(np.float32)


def frames(spark, queries, store, k=None):
    rng = np.random.default_rng(3)
    q = [(i, v.tolist(), int(k or rng.integers(1, 9)), i % 3) for i, v in enumerate(queries)]
    s = [(i, v.tolist(), i % 3) for i, v in enumerate(store)]
    return (
        spark.createDataFrame(q, "query_id bigint, query_vec array<float>, k int, g int"),
        spark.createDataFrame(s, "chunk_id bigint, embedding array<float>, h int"),
    )


def brute(queries, store, ks, same=False):
    out = set()
    for i, q in enumerate(queries.astype(np.float64)):
        d = np.round(np.sqrt(((store.astype(np.float64) - q) ** 2).sum(axis=1)), 6)
        ids = [j for j in range(len(store)) if not (same and i % 3 != j % 3)]
        ids.sort(key=lambda j: (d[j], j))
        out |= {(i, r + 1, j) for r, j in enumerate(ids[: ks[i]])}
    return out


@pytest.mark.parametrize("sizes", [(1 << 22, 1 << 20, 64), (400, 700, 2)])
@pytest.mark.parametrize("same", [False, True])
def test_any_grid_equals_brute_force_with_many_copies(spark, monkeypatch, sizes, same):
    monkeypatch.setattr(N, "BLOCK_ROWS", 32)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(N, "QUERY_BYTES", sizes[0])
    monkeypatch.setattr(N, "STORE_BYTES", sizes[1])
    monkeypatch.setattr(N, "BRANCH", sizes[2])
    queries, store = points(1, 90), points(2, 400)
    queries[:40] = store[:40]
    q, s = frames(spark, queries, store)
    ks = {r.query_id: r.k for r in q.collect()}
    got = nearest(q, s, F.col("k"), ("g", "h") if same else None)
    assert {(r.query_id, r["rank"], r.chunk_id) for r in got.collect()} == brute(queries, store, ks, same)


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_no_query_goes_through_the_driver_and_jobs_do_not_grow(spark, monkeypatch):
    """Ten times the queries, in ten times the blocks: the same number of jobs, and only sizes are collected."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(N, "QUERY_BYTES", 600)
    seen, first = [], DataFrame.first

    def watched(self):
        row = first(self)
        seen.append(row)
        return row

    monkeypatch.setattr(DataFrame, "first", watched)
    for name in ("toArrow", "toPandas"):
        monkeypatch.delattr(DataFrame, name)
    counts = []
    for n in (40, 400):
        q, s = frames(spark, points(1, n), points(2, 50), k=5)
        found = spark.sparkContext.parallelize([0], 1)  # starts the scheduler before jobs are counted
        found.count()
        counts.append(jobs(spark, f"grid-{n}", lambda: nearest(q, s, F.col("k")).write.format("noop").mode("overwrite").save()))
    assert counts[0] == counts[1]
    assert all(isinstance(v, int) for row in seen for v in row)


def test_only_rows_with_equal_filter_values_are_compared(spark, monkeypatch):
    """Products counted: the sum over filter values of queries times rows, with hot, small and missing values."""
    monkeypatch.setattr(N, "QUERY_BYTES", 500)
    monkeypatch.setattr(N, "STORE_BYTES", 900)
    queries, store = points(1, 120), points(2, 300)
    q, s = frames(spark, queries, store, k=3)
    label = F.when(F.col("chunk_id") < 200, 7).otherwise(F.col("chunk_id") % 40).cast("bigint")
    q, s = q.withColumn("g", F.when(F.col("query_id") < 60, 7).otherwise(F.col("query_id") % 50).cast("bigint")), s.withColumn("h", label)
    asked = q.select("query_id", F.col("query_vec").alias("vec"), F.col("g").alias("part"), F.lit(1e9).alias("reach"), "k", F.col("k").alias("fetch"))
    rows = s.select("chunk_id", F.col("embedding").alias("vec"), F.col("h").alias("part"))
    left, right = N.grid(asked, rows, True, 120 * 24, 300 * 24)
    cells = ["alone", "cell", "q", "s"]
    mine = {tuple(r): t for r, t in cells_of(left, cells).items()}
    products, largest = 0, 0
    plain = N.square_distances

    def counted(a, b):
        nonlocal products
        products += len(a) * len(b)
        return plain(a, b)

    monkeypatch.setattr(N, "square_distances", counted)
    theirs = cells_of(right, cells)
    for cell, table in mine.items():
        if cell in theirs:
            largest = max(largest, theirs[cell].num_rows)
            N.meet(table, theirs[cell])
    by_q, by_s = ({r[0]: r[1] for r in side.groupBy("part").count().collect()} for side in (asked, rows))
    assert products == sum(n * by_s.get(p, 0) for p, n in by_q.items())
    assert largest < 150  # the hot value is cut


def cells_of(side, cells):
    out = {}
    for key in {tuple(r) for r in side.select(*cells).distinct().collect()}:
        some = side.filter(" and ".join(f"{c} = {str(v).lower()}" for c, v in zip(cells, key)))
        out[key] = pa.Table.from_batches(some.toArrow().to_batches())
    return out


def test_a_query_finds_the_chunk_with_its_own_number(spark):
    q = spark.createDataFrame([(7, [1.0, 0.0], 1, 0)], "query_id bigint, query_vec array<float>, k int, g int")
    s = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "chunk_id bigint, embedding array<float>")
    assert [r.chunk_id for r in nearest(q, s, F.col("k")).collect()] == [7]


@pytest.mark.parametrize("far", [10**3, 10**9, 2**61])
def test_filter_values_far_apart(spark, far):
    queries, store = points(1, 30), points(2, 120)
    q, s = frames(spark, queries, store, k=4)
    q, s = q.withColumn("g", F.col("g").cast("bigint") * far), s.withColumn("h", F.col("h").cast("bigint") * far)
    got = nearest(q, s, F.col("k"), ("g", "h"))
    assert {(r.query_id, r["rank"], r.chunk_id) for r in got.collect()} == brute(queries, store, [4] * 30, True)


def test_small_stores_and_queries_without_a_vector(spark):
    queries, store = points(4, 5), points(5, 3)
    q, s = frames(spark, queries, store, k=50)
    nothing = spark.createDataFrame([(99, None, 50, 0)], q.schema)
    got = nearest(q.union(nothing), s, F.col("k"))
    assert {(r.query_id, r["rank"], r.chunk_id) for r in got.collect()} == brute(queries, store, [50] * 5)


def test_no_queries_or_no_store(spark):
    q, s = frames(spark, points(4, 2), points(5, 3), k=5)
    assert nearest(q, s.filter("false"), F.col("k")).count() == 0
    assert nearest(q.filter("false"), s, F.col("k"), vectors=True).count() == 0


def test_vectors_of_different_length_are_refused():
    with pytest.raises(ValueError):
        as_matrix(pa.array([[1.0, 2.0], [1.0, 2.0, 3.0], [1.0]]))


def test_fetch_takes_both_branches(spark):
    got = spark.createDataFrame([(5,), (16,), (17,), (25,)], "k int").select(fetch_size(F.col("k"))).collect()
    assert [r[0] for r in got] == [50, 50, 51, 75]


def candidates(spark, vectors, query, k):
    v = np.array(vectors, float)
    q = np.array(query, float)
    sims = (v @ q) / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))
    order = sorted(range(len(v)), key=lambda i: (-round(sims[i], 9), i))
    rows = [(1, i, r + 1, float(sims[i]), v[i].tolist(), k) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, rank int, similarity double, embedding array<float>, k int")


def picked(df, balance):
    return [r.chunk_id for r in rerank.mmr(df, balance).orderBy("pos").collect()]


def test_mmr_by_hand(spark):
    """Two equal vectors close to the query and one that differs: similarity alone takes the twins; with 0.6 the
    second twin scores 0.6 * 0.8 - 0.4 * 1 = 0.08 and the other one 0.6 * 0.6 - 0.4 * 0.96 < 0.6 * 0.6 - 0.4 * 0."""
    df = candidates(spark, [[0.8, 0.6], [0.8, 0.6], [0.6, -0.8]], [1, 0], 2)
    assert picked(df, 1.0) == [0, 1]
    assert picked(df, 0.6) == [0, 2]


def test_mmr_is_a_subset_without_repeats(spark):
    df = candidates(spark, points(6, 40), points(7, 1)[0], 12)
    for balance in (0.0, 0.6, 1.0):
        got = picked(df, balance)
        assert len(got) == len(set(got)) == 12
    assert picked(df, 1.0) == [r.chunk_id for r in df.orderBy("rank").limit(12).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_clustered_search_equals_a_full_one(spark, seed):
    from pliego.operators import clusters

    queries, store = points(seed, 60), points(seed + 10, 500)
    queries[:20] = store[:20]
    q, s = frames(spark, queries, store)
    nothing = spark.createDataFrame([(999, None, 3, 0)], q.schema)
    lost = spark.createDataFrame([(7000, None, 0)], s.schema)
    built = clusters.build(s.union(lost), cell_rows=12)
    assert sum(built.sizes) == 500 and len(built.numbers) > 5
    ks = {r.query_id: r.k for r in q.collect()}
    got = clusters.search(q.union(nothing), built, F.col("k")).collect()
    assert {(r.query_id, r["rank"], r.chunk_id) for r in got} == brute(queries, store, ks)
    # two rows of every cell a query skips are farther than its last result
    plain = {(r.query_id, r["rank"]): r.distance for r in nearest(q, s, F.col("k")).collect()}
    assert {(r.query_id, r["rank"]): r.distance for r in got} == plain


def test_a_query_reads_a_part_of_a_clustered_store(spark):
    from pliego.operators import clusters

    rng = np.random.default_rng(1)
    centres = 10 * rng.normal(size=(20, 6))
    store = (centres[rng.integers(0, 20, 2000)] + 0.05 * rng.normal(size=(2000, 6))).astype(np.float32)
    q, s = frames(spark, store[:100], store, k=5)
    built = clusters.build(s, cell_rows=50)
    asked = q.select("query_id", "query_vec", "k", F.col("k").alias("fetch"), F.lit(0.3).alias("reach"))
    size = dict(zip(built.numbers.tolist(), built.sizes.tolist()))
    read = sum(size[r.cell] for second in (False, True) for r in clusters.visits(asked, built, second).collect())
    assert read < 0.3 * 100 * 2000
    plan = clusters._read(built, clusters.visits(asked.limit(1), built, False))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_clustered_stores_without_rows_or_with_one_point(spark):
    from pliego.operators import clusters

    q, s = frames(spark, points(4, 3), points(5, 40), k=4)
    assert clusters.search(q, clusters.build(s.filter("false")), F.col("k")).count() == 0
    same = s.withColumn("embedding", F.array(*[F.lit(1.0).cast("float")] * 6))
    got = clusters.search(q, clusters.build(same, cell_rows=4), F.col("k")).collect()
    assert {(r["rank"], r.chunk_id) for r in got} == {(i + 1, i) for i in range(4)}


def test_answerable_needs_no_search(spark):
    q, s = frames(spark, points(4, 2), points(5, 3), k=4)
    nothing = spark.createDataFrame([(9, None, 1, 0), (10, [1.0], 1, 0)], q.schema)
    found = N.answerable(q.union(nothing), s)
    assert {(r.query_id, r.answerable) for r in found.collect()} == {(0, True), (1, True), (9, False), (10, False)}
    assert not any(r.answerable for r in N.answerable(q, s.filter("false")).collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_cells_of_a_large_store_give_few_rows(spark, monkeypatch):
    """Ten times the blocks of a store: the rows all cells give for a query do not grow with them."""
    queries, store = points(1, 40, copies=0), points(2, 6000, copies=0)
    q, s = frames(spark, queries, store, k=5)
    given, plain = [], N.met

    def counted(*how):
        found = plain(*how)
        given.append(found.count())
        return found

    monkeypatch.setattr(N, "met", counted)
    totals = []
    for size in (20_000, 2_000):
        monkeypatch.setattr(N, "STORE_BYTES", size)
        given.clear()
        got = {(r.query_id, r["rank"], r.chunk_id) for r in nearest(q, s, F.col("k")).collect()}
        assert got == brute(queries, store, [5] * 40)
        totals.append(sum(given))
    assert totals[0] < 40 * 5 * 10 and totals[1] < 40 * 5 * 30  # plain blocks give 8 and 72 lists of 5
    assert totals[1] < 3 * totals[0]


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e18])
def test_near_ties_are_decided_in_double_precision(spark, scale):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1, 16))
    store = (scale * (base + 1e-5 * rng.normal(size=(3000, 16)))).astype(np.float32)
    q, s = frames(spark, store[:50], store, k=7)
    got = {(r.query_id, r["rank"], r.chunk_id) for r in nearest(q, s, F.col("k")).collect()}
    assert got == brute(store[:50], store, [7] * 50)


@pytest.mark.parametrize("most", [0, 1000])
def test_clusters_that_spare_little_meet_on_the_grid(spark, monkeypatch, most):
    """Queries that would be copied to most cells are not; the rows are the same, and a part of a batch is held at once."""
    from pliego.operators import clusters

    monkeypatch.setattr(clusters, "MOST_VISITS", most)
    monkeypatch.setattr(clusters, "PART", 7)
    rng = np.random.default_rng(5)
    queries, store = (rng.normal(size=(n, 30)).astype(np.float32) for n in (40, 600))
    q, s = frames(spark, queries, store, k=6)
    copied, plain = [], clusters.visits
    monkeypatch.setattr(clusters, "visits", lambda asked, index, second: copied.append(second) or plain(asked, index, second))
    got = clusters.search(q, clusters.build(s, cell_rows=12), F.col("k")).collect()
    assert {(r.query_id, r["rank"], r.chunk_id) for r in got} == brute(queries, store, [6] * 40)
    assert copied == ([False, True] if most else [False])


def test_the_grid_copies_few_bytes(spark):
    """A store of many times the queries' bytes is not copied once per core, however few blocks it has."""
    q, s = frames(spark, points(1, 64), points(2, 64), k=3)
    asked = q.select("query_id", F.col("query_vec").alias("vec"), F.lit(0).alias("part"), F.lit(1e9).alias("reach"), "k", F.col("k").alias("fetch"))
    rows = s.select("chunk_id", F.col("embedding").alias("vec"), F.lit(0).alias("part"))
    asked_bytes, rows_bytes = 4 << 20, 60 << 20
    left, right = N.grid(asked, rows, False, asked_bytes, rows_bytes)
    copied = left.count() // 64 * asked_bytes + right.count() // 64 * rows_bytes
    cells = left.select(*N.CELL).distinct().count()
    assert cells >= spark.sparkContext.defaultParallelism // 2
    assert copied <= rows_bytes + 2 * spark.sparkContext.defaultParallelism * asked_bytes


def test_blocks_are_bounded_and_enough():
    for asked, rows in [(0, 0), (1 << 18, 1 << 30), (1 << 30, 1 << 18), (200 << 20, 5 << 30), (13 << 20, 335 << 20)]:
        q, s = N.shape(asked, rows, 24)
        assert asked <= q * N.QUERY_BYTES and rows <= s * N.STORE_BYTES
        assert q * s >= 24 or (q >= asked // N.LEAST_BYTES and s >= rows // N.LEAST_BYTES)
        assert q * s < 48 or (q, s) == (-(-asked // N.QUERY_BYTES), -(-rows // N.STORE_BYTES))


def test_the_first_search_moves_distances_only(spark, monkeypatch):
    """The part of a store that is searched first gives single distances, which bound the rows of the whole search."""
    monkeypatch.setattr(N, "STORE_BYTES", 2_000)
    queries, store = points(1, 40, copies=0), points(2, 2000, copies=0)
    q, s = frames(spark, queries, store, k=5)
    asked = q.select("query_id", F.col("query_vec").alias("vec"), F.lit(0).cast("bigint").alias("part"), F.lit(np.inf).alias("reach"), "k", F.col("k").alias("fetch"))
    rows = s.select("chunk_id", F.col("embedding").alias("vec"), F.lit(0).cast("bigint").alias("part"))
    last = N.last_distances(asked, rows, 40 * 24, 2000 * 24)
    assert dict(last.dtypes) == {"query_id": "bigint", "_last": "double"}
    away = np.sqrt(((queries[:, None, :].astype(np.float64) - store[None, :, :]) ** 2).sum(axis=2))
    fifth = np.sort(away, axis=1)[:, 4]
    found = {r.query_id: r._last for r in last.collect()}
    assert len(found) == 40
    assert all(fifth[i] <= found[i] + 1e-6 and (away[i] <= found[i]).sum() < 100 for i in range(40))
    few = N.last_distances(asked, rows.filter("chunk_id < 3"), 40 * 24, 3 * 24)
    assert all(r._last is None for r in few.collect())


def shuffle_blocks(spark):
    names = str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks())
    return {int(n.split("_")[0]) for n in names.split("shuffle_")[1:]}


def test_a_written_step_leaves_no_shuffle_files(spark):
    from pliego.session import CLEANUP, kept

    setting, before = spark.conf.get(CLEANUP), shuffle_blocks(spark)
    step = kept(spark.range(1000).repartition(5, "id").groupBy(F.col("id") % 7).count(), "step")
    for _ in range(40):
        left = shuffle_blocks(spark) - before
        if not left:
            break
        time.sleep(0.25)
    assert not left and step.count() == 7
    assert spark.conf.get(CLEANUP) == setting


@pytest.mark.parametrize("few", [False, True])
def test_a_large_store_is_searched_within_a_likely_distance(spark, monkeypatch, few):
    """A sixteenth of the rows is searched first. Queries for which its distance was not enough are searched again."""
    monkeypatch.setattr(N, "LARGE_BYTES", 2_000)
    monkeypatch.setattr(N, "STORE_BYTES", 4_000)
    if few:
        monkeypatch.setattr(N, "likely", lambda fetch, share: F.lit(1))
    queries, store = points(1, 40, copies=0.1), points(2, 3000, copies=0.1)
    q, s = frames(spark, queries, store)
    ks = {r.query_id: r.k for r in q.collect()}
    seen, plain = [], N.last_distances

    def watched(asked, rows, asked_bytes, rows_bytes, level=0, share=N.SHARE):
        seen.append((rows_bytes, share))
        return plain(asked, rows, asked_bytes, rows_bytes, level, share)

    monkeypatch.setattr(N, "last_distances", watched)
    got = nearest(q, s, F.col("k")).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == sorted(brute(queries, store, ks))
    assert seen[0] == (3000 * 24, 16) and seen[1] == (3000 * 24 // 16, N.SHARE)


def test_a_likely_distance_and_repeated_queries(spark, monkeypatch):
    monkeypatch.setattr(N, "LARGE_BYTES", 2_000)
    queries, store = points(1, 20), points(2, 800)
    q, s = frames(spark, queries, store)
    plain = sorted(map(tuple, nearest(q.union(q), s, F.col("k")).collect()))
    monkeypatch.setattr(N, "STORE_BYTES", 4_000)
    assert sorted(map(tuple, nearest(q.union(q), s, F.col("k")).collect())) == plain


def test_products_stay_in_the_cache(monkeypatch):
    """Strips of queries against a block of rows, and the best pairs of a plain search."""
    seen, plain = [], N.square_distances
    monkeypatch.setattr(N, "square_distances", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    queries, store = points(1, 900), points(2, N.BLOCK_ROWS)
    reach = np.full(900, 0.3)
    asked = N.Side(np.arange(900), queries, {"reach": reach, "k": np.full(900, 5), "fetch": np.full(900, 5)})
    rows, columns, near = N.best_pairs(asked, N.Side(np.arange(len(store)), store, {}), 5, np.zeros(900, bool))
    assert max(seen) <= 256 * 1024 and sum(seen) == 900 * len(store)
    away = ((queries[:, None, :].astype(np.float64) - store[None]) ** 2).sum(axis=2)
    for i in range(0, 900, 90):
        best = [j for j in np.lexsort((np.arange(len(store)), np.rint(np.sqrt(away[i]) * 1e6)))[:5] if np.sqrt(away[i, j]) <= 0.3]
        assert columns[rows == i].tolist() == sorted(best) and np.allclose(near[rows == i], away[i, sorted(best)])


def greedy(similarity, vectors, k, balance):
    alike = vectors @ vectors.T
    chosen = []
    for _ in range(min(k, len(similarity))):
        score = [balance * s - (1 - balance) * max((alike[j, i] for j in chosen), default=0) for i, s in enumerate(similarity)]
        free = [i for i in range(len(score)) if i not in chosen]
        chosen.append(max(free, key=lambda i: (round(score[i] if chosen else similarity[i], 9), -i)))
    return chosen


@pytest.mark.parametrize("balance", [0.0, 0.6])
def test_all_queries_of_a_batch_are_chosen_at_once(spark, monkeypatch, balance):
    """Queries with different numbers of candidates, also more than a batch holds, against a choice one by one."""
    monkeypatch.setattr(rerank, "ALIKE", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rng, rows, expected, alike = np.random.default_rng(8), [], set(), []
        for query, n in enumerate([1, 30, 4, 2, 40, 3, 7, 7]):
            vectors = rng.normal(size=(n, 5)).astype(np.float32)
            vectors[n // 2 :: 3] = vectors[0]
            similarity = -np.sort(-np.round(rng.random(n), 2))
            k = 1 + 3 * query
            unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
            order = greedy(similarity, unit, k, balance)
            expected |= {(query, pos + 1, 100 * query + at) for pos, at in enumerate(order)}
            among = (unit[order] @ unit[order].T)[~np.eye(len(order), dtype=bool)]
            alike += [(similarity[order].mean(), among.mean() if len(order) > 1 else None)]
            rows += [(query, 100 * query + i, i + 1, float(similarity[i]), vectors[i].tolist(), k) for i in range(n)]
        df = spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, rank int, similarity double, embedding array<float>, k int")
        found = rerank.mmr(df.repartition(3), balance)
        assert {(r.query_id, r.pos, r.chunk_id) for r in found.collect()} == expected
        assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()
        told = rerank.lambda_sweep(df, [balance]).first()
        assert told.queries == 8 and told.mean_similarity == pytest.approx(np.mean([a for a, _ in alike]), abs=2e-6)
        assert told.mean_pairwise == pytest.approx(np.mean([b for _, b in alike if b is not None]), abs=2e-6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_centres_are_means_of_all_their_rows(spark):
    """Rounds of k-means without Spark's, against plain ones; no more than the centres is collected."""
    from pliego.operators import clusters

    rng = np.random.default_rng(2)
    store = (rng.normal(size=(8, 6))[rng.integers(0, 8, 700)] * 5 + rng.normal(size=(700, 6))).astype(np.float32)
    _, s = frames(spark, store[:1], store)
    centres = clusters.first_centres(s, 12)
    assert len(centres) == len(np.unique(centres, axis=0)) == 12
    assert {tuple(c) for c in centres} <= {tuple(v) for v in store.astype(float)}
    far = np.r_[centres, np.full((1, 6), 1e6)]
    near = ((store[:, None].astype(float) - far[None]) ** 2).sum(axis=2).argmin(axis=1)
    expected = np.array([store[near == c].astype(float).mean(axis=0) if (near == c).any() else far[c] for c in range(13)])
    assert np.allclose(clusters.means(s.repartition(5), far), expected)
    copies = s.withColumn("embedding", F.array(*[F.lit(1.0).cast("float")] * 6))
    assert clusters.first_centres(copies, 5).tolist() == [[1.0] * 6]
