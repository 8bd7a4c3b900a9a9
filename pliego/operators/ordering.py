"""Ordered numbering and running sums that do not put a whole group into one task.

A plain window over ``source`` or ``thread_id`` sorts that key's rows in one task, so one key with a third of the
rows would be the job. Here rows are range partitioned on (group, key) into slices of a bounded number of rows; each slice
of a group is a window partition of its own, one row of sums per slice and group is carried on to the later slices, and both
parts are added. The number of slices grows with the rows, so a task's share does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from pliego.session import kept

SLICE_ROWS = 250_000
DENSE_SPAN = 4096  # slice width for keys that count from 0 without large gaps, such as turns


def sliced(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """The rows with the number of their slice, ``_slice``, which grows with (group, key).

    Range bounds are sampled by each run, so the rows are written with the slice they fell into: the sums and the
    rows themselves have to see the same ones."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    slices = max(cores, -(-rows.count() // SLICE_ROWS))
    return kept(rows.repartitionByRange(slices, *group, key).withColumn("_slice", F.spark_partition_id()), "slices")


def running_totals(
    rows: DataFrame,
    group: list[str],
    key: str,
    values: dict[str, Column],
    span: int | None = None,
    about: DataFrame | None = None,
) -> DataFrame:
    """Add, for each name in ``values``, its sum over the earlier rows of the group and ``<name>_total``.

    Without group columns all rows are one group. ``span`` is the width of a slice, for keys that count up without large
    gaps; without it slices are ranges of a bounded number of rows. ``key`` is an integer that is unique within the group, ``values`` are
    integers, group columns are not null. ``about`` has one row per group; its columns come along with the slice sums, so the rows themselves need no join
    on a key that may be hot.
    """
    valued = rows.withColumns({f"_v_{n}": v.cast("bigint") for n, v in values.items()})
    if span:
        cut = valued.withColumn("_slice", F.call_function("div", F.col(key), F.lit(span)))
    else:
        cut = sliced(valued, group, key)
    by_slice = [*group, "_slice"]

    so_far = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    bases = (
        cut.groupBy(*by_slice)
        .agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
        .select(
            *by_slice,
            *[F.coalesce(F.sum(f"_s_{n}").over(so_far), F.lit(0)).alias(f"_b_{n}") for n in values],
            *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in values],
        )
    )
    if about is not None:
        bases = bases.join(about, group)
    inside = W.partitionBy(*by_slice).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    return local.join(bases, by_slice).select(
        *rows.columns,
        *[(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in values],
        *[f"{n}_total" for n in values],
        *[c for c in (about.columns if about is not None else []) if c not in group],
    )


def row_index(
    rows: DataFrame, group: list[str], key: str, name: str, span: int | None = None, about: DataFrame | None = None
) -> DataFrame:
    """Number the rows of each group from 0 in ``key`` order."""
    return running_totals(rows, group, key, {name: F.lit(1)}, span, about).drop(f"{name}_total")


def nearby_rows(
    rows: DataFrame, group: list[str], seq: str, value: Column, before: int, after: int = 0, span: int = DENSE_SPAN
) -> DataFrame:
    """Add ``earlier`` and ``later``: the ``value`` of up to that many rows before and after each row, in order.

    ``seq`` counts the group's rows from 0. The rows at the edges of a slice are copied into the neighbour slice, so
    every row finds its neighbours inside its own slice."""
    if span < before + after:
        raise ValueError("a slice has to be wider than the neighbourhood")
    at = F.col(seq) % span
    home = F.call_function("div", F.col(seq), F.lit(span))

    def copy(slice_no: Column, own: bool) -> Column:
        return F.struct(slice_no.alias("slice"), F.lit(own).alias("own"))

    copies = F.filter(
        F.array(
            copy(home, True),
            F.when(at >= span - before, copy(home + 1, False)),
            F.when((at < after) & (home > 0), copy(home - 1, False)),
        ),
        lambda c: c.isNotNull(),
    )
    spread = rows.withColumn("_value", value).withColumn("_at", F.explode(copies))
    order = W.partitionBy(*group, "_at.slice").orderBy(seq)
    return (
        spread.withColumns(
            {
                "earlier": F.collect_list("_value").over(order.rowsBetween(-before, -1)),
                "later": F.collect_list("_value").over(order.rowsBetween(1, after)) if after else F.array(),
            }
        )
        .filter("_at.own")
        .select(*rows.columns, "earlier", "later")
    )
