"""Centroid clustering of whole vectors with scalar lookup tables.

Each round tabulates the squared difference of every (dimension, occurring integer value) to every centroid; the distances of
a vector are then sums of table rows, gathered by NumPy. Vectors stay where they are: a task hands on one row of sums per
cluster and dimension, Spark adds them up, and only the centroids, whose number is a parameter, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pliego.session import kept

SCALE = 64
CLUSTERS, ROUNDS, SEED = 16, 3, 1
BLOCK = 4096  # vectors that are tabulated together
WIDE = 1 << 27  # components beyond this are summed as Python integers, which have no limit
LONGEST = (1 << 63) - 1


def usable(vector: str, width: int) -> Column:
    """Whether a vector has ``width`` components, all of them finite numbers."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) == width) & fine, F.lit(False))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as 64-bit integers where that is exact and else as Python integers."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if np.abs(scaled).max(initial=0) <= WIDE:
        return scaled.astype(np.int64)
    return np.vectorize(int, otypes=[object])(scaled)


def occurring(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimension, value) of each table row, in that order, and the table row of every component of the block."""
    codes, dimensions, values, base = np.empty(x.shape, np.int64), [], [], 0
    for d in range(x.shape[1]):
        column = x[:, d]
        low, high = column.min(), column.max()
        if high - low < 4 * len(column):  # few possible values: marked instead of sorted, with the same outcome
            at = (column - low).astype(np.int64)
            seen = np.zeros(int(high - low) + 1, bool)
            seen[at] = True
            code, found = (np.cumsum(seen) - 1)[at], np.flatnonzero(seen) + low
        else:
            found, code = np.unique(column, return_inverse=True)
        codes[:, d] = base + code
        dimensions.append(np.full(len(found), d))
        values.append(found)
        base += len(found)
    return np.concatenate(dimensions), np.concatenate(values), codes


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (the smaller number of equally near ones) and the squared distance to it."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > WIDE:
        x, centroids = x.astype(object), centroids.astype(object)
    dimensions, values, codes = occurring(x)
    table = (values[:, None] - centroids.T[dimensions]) ** 2
    distances = table[codes[:, 0]]
    for d in range(1, x.shape[1]):
        distances += table[codes[:, d]]
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(x)), best]


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            yield some.column("vec_id"), whole(some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)


def _sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(cluster, dimension, n, total): the sums of each cluster's vectors by component."""
    k, width = centroids.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [0] * k, [[0] * width for _ in range(k)]
        for _, x in _blocks(batches, width, scale):
            best, _ = nearest(x, centroids)
            for c in np.unique(best).tolist():
                mine = x[best == c]
                counts[c] += len(mine)
                totals[c] = [a + int(b) for a, b in zip(totals[c], mine.sum(axis=0))]
        used = [c for c in range(k) if counts[c]]
        yield pa.record_batch(
            [
                pa.array(np.repeat(np.array(used, np.int32), width)),
                pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                pa.array([counts[c] for c in used for _ in range(width)], pa.int64()),
                pa.array([Decimal(t) for c in used for t in totals[c]], pa.decimal128(38, 0)),
            ],
            names=["cluster", "dimension", "n", "total"],
        )

    parts = rows.mapInArrow(scan, "cluster int, dimension int, n bigint, total decimal(38,0)")
    return parts.groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The centroids with every one that has vectors at their exact componentwise floor of the mean."""
    out = centroids.astype(object)
    for r in sums.collect():  # clusters x dimensions rows
        out[r.cluster, r.dimension] = int(r.total) // r.n
    return out if np.abs(out).max() > WIDE else out.astype(np.int64)


def _assigned(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, centroids.shape[1], scale):
            best, distance = nearest(x, centroids)
            far = [min(int(d), LONGEST) for d in distance] if distance.dtype == object else distance
            yield pa.record_batch([ids, pa.array(best.astype(np.int32)), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(scan, "vec_id bigint, cluster int, distance bigint")


def first_centroids(rows: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order; equal ids go by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.filter("vec_id is not null").select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return whole(np.array([r.x for r in chosen], np.float64), scale)


def cluster(
    vectors: DataFrame,
    vector: str = "embedding",
    width: int = 64,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    scale: int = SCALE,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable vector.

    Vectors that are null, have another width or a null, NaN or infinite component are left out. Every row counts for itself:
    rows that share a vec_id, and repeated rows, are vectors each; a row without vec_id takes part but is no first centroid.
    Equally near centroids: the smaller number. With fewer vectors than ``k`` there are fewer centroids; an empty table,
    or one without any vec_id, gives no rows. Components of any size are compared exactly; a distance, or a sum of
    distances, beyond 64 bits is given as the largest 64-bit number. Other columns are ignored.
    """
    spark = vectors.sparkSession
    fine = vectors.filter(usable(vector, width)).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    centroids = first_centroids(fine, k, scale, seed)
    result = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        centroids = _moved(centroids, _sums(fine, centroids, scale))
    rows = kept(_assigned(fine, centroids, scale), "assigned")
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    inertia = min(sum(sums.values()), LONGEST)
    about = [(c, min(s, LONGEST), inertia, digests[c]) for c, s in sorted(sums.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select(*[c.split()[0] for c in result.split(", ")])


def sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same clustering as unrolled rounds for DuckDB; inner products of whole doubles are exact."""
    ctes = [
        "v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), x) - 1)::INT AS cluster, x AS c FROM v"
        f" WHERE vec_id IS NOT NULL QUALIFY cluster < {k})",
    ]
    near = (
        "SELECT i, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT i, cluster, (list_inner_product(x, x)"
        " - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT AS d FROM v, c{0}) GROUP BY i"
    )
    for r in range(1, rounds + 1):
        ctes += [
            f"a{r} AS ({near.format(r - 1)})",
            f"s{r} AS (SELECT cluster, p, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(x)::BIGINT AS e,"
            f" generate_subscripts(x, 1) AS p FROM a{r} JOIN v USING (i)) GROUP BY cluster, p)",
            f"m{r} AS (SELECT cluster, list(((s - ((s % n + n) % n)) // n)::DOUBLE ORDER BY p) AS m FROM s{r} GROUP BY cluster)",
            f"c{r} AS (SELECT cluster, coalesce(m, c) AS c FROM c{r - 1} LEFT JOIN m{r} USING (cluster))",
        ]
    return (
        f"WITH {', '.join(ctes)}, f AS ({near.format(rounds)})\n"
        "SELECT vec_id, cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,"
        " sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256"
        f" FROM f JOIN v USING (i) JOIN c{rounds} USING (cluster)"
    )
