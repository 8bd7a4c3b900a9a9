import random

from pyspark.sql import functions as F

from pliego.operators import ordering
from pliego.operators.ordering import nearby_rows, row_index, running_totals, sliced


def test_running_totals_match_a_plain_loop_with_one_hot_group(spark):
    rng = random.Random(1)
    keys = rng.sample(range(100_000), 900)
    rows = [("hot" if i % 3 else f"g{i % 7}", key, rng.randint(0, 9)) for i, key in enumerate(keys)]
    df = spark.createDataFrame(rows, "g string, key bigint, v int")
    for span in (64, None):
        got = {
            (r.g, r.key): (r.n, r.s, r.n_total, r.s_total)
            for r in running_totals(df, ["g"], "key", {"n": F.lit(1), "s": F.col("v")}, span).collect()
        }
        for name in {r[0] for r in rows}:
            mine = sorted(r for r in rows if r[0] == name)
            for i, (_, key, _) in enumerate(mine):
                assert got[name, key] == (i, sum(r[2] for r in mine[:i]), len(mine), sum(r[2] for r in mine))


def test_group_columns_come_along(spark):
    df = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "g bigint, key bigint")
    about = spark.createDataFrame([(1, "a"), (2, "b")], "g bigint, name string")
    got = {(r.g, r.i, r.name) for r in row_index(df, ["g"], "key", "i", 4, about).collect()}
    assert got == {(1, 0, "a"), (1, 1, "a"), (2, 0, "b")}


def largest_slice(df, group=()):
    cut = sliced(df, list(group), "key")
    return cut.groupBy(*group, "_slice").count().agg(F.max("count")).first()[0]


def test_window_partitions_stay_bounded_when_rows_grow_tenfold(spark, monkeypatch):
    """Most rows in one group, keys of any size: the slices become more, not larger."""
    monkeypatch.setattr(ordering, "SLICE_ROWS", 1000)
    for n in (20_000, 200_000):
        rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("g"), (F.xxhash64("id")).alias("key"))
        assert largest_slice(rows, ["g"]) <= 2500
    outlier = spark.range(50_000).union(spark.range(1).select(F.lit(10**17).alias("id"))).withColumnRenamed("id", "key")
    assert largest_slice(outlier) <= 2500


def test_windows_are_partitioned_by_slice(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 9, 1), (2, 1, 7)], "g bigint, key bigint, v bigint")
    plan = running_totals(df, ["g"], "key", {"s": F.col("v")})._jdf.queryExecution().optimizedPlan().toString()
    local = [line for line in plan.split("\n") if "Window [" in line and "key#" in line]
    assert local and all("_slice" in line for line in local)


def test_keys_at_the_ends_of_their_type(spark):
    ends = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,), (5,)], "key bigint")
    got = {(r.key, r.i) for r in row_index(ends, [], "key", "i").collect()}
    assert got == {(-(2**63), 0), (0, 1), (5, 2), (2**63 - 1, 3)}
    assert row_index(ends.filter("false"), [], "key", "i").count() == 0


def test_nearby_rows_cross_slice_borders(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 23), ("b", 1), ("c", 8)) for i in range(n)], "g string, seq int")
    got = nearby_rows(df, ["g"], "seq", F.col("seq"), 4, 1, span=5).collect()
    assert len(got) == 32
    for r in got:
        last = {"a": 23, "b": 1, "c": 8}[r.g]
        assert r.earlier == list(range(max(0, r.seq - 4), r.seq))
        assert r.later == list(range(r.seq + 1, min(last, r.seq + 2)))
