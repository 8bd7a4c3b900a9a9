"""A table with the newest row of every chat state, kept while batches of changed states arrive.

States are dealt to buckets by their conversation. A bucket has two sides: a batch reads the current side of the buckets it
changes, merges its rows, and writes the other side. Then the manifest, one row per bucket with its current side and the
last batch, is replaced, which makes the batch visible as a whole. A batch that fails before that is repeated from the same
sides; one that is replayed after it changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

BUCKETS = 64
STATE = "conv_id bigint, block bigint, began bigint, messages bigint, tail string"
MANIFEST = "bucket int, side int, batch bigint"
KEY = ["conv_id", "block", "began"]


def manifest(spark: SparkSession, path: str) -> list[Row]:
    """(bucket, side, batch) of every bucket that was ever written: the newer of two folders, which are written in turn."""
    found: list[list[Row]] = []
    for turn in (0, 1):
        try:
            found.append(spark.read.schema(MANIFEST).parquet(f"{path}/manifest-{turn}").collect())  # a row per bucket
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return max(found, key=lambda rows: max((r.batch for r in rows), default=-1), default=[])


def _current(spark: SparkSession, path: str, entries: list[Row]) -> DataFrame:
    """Rows of the given buckets, with their bucket; only those buckets' folders are read."""
    by_side = {side: [r.bucket for r in entries if r.side == side] for side in (0, 1)}
    sides = [
        spark.read.schema(f"{STATE}, bucket int").parquet(f"{path}/side-{side}").filter(F.col("bucket").isin(buckets))
        for side, buckets in by_side.items()
        if buckets
    ]
    empty = spark.createDataFrame([], f"{STATE}, bucket int")
    return empty if not sides else sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def merge(batch: DataFrame, number: int, path: str) -> None:
    """Merge the changed states of batch ``number`` into the table; of rows of one state that with most messages stays."""
    spark = batch.sparkSession
    entries = manifest(spark, path)
    if number <= max((r.batch for r in entries), default=-1):
        return
    # the states are used up once read, and the rows are needed for the buckets and for the merge
    changed = batch.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(BUCKETS)).cast("int")).persist()
    try:
        touched = {r.bucket for r in changed.select("bucket").distinct().collect()}
        side = {r.bucket: r.side for r in entries}
        rows = changed.unionByName(_current(spark, path, [r for r in entries if r.bucket in touched]))
        rows = rows.groupBy("bucket", *KEY).agg(F.max(F.struct("messages", "tail")).alias("s"))
        rows = rows.select(*KEY, "s.messages", "s.tail", "bucket")
        for now in (0, 1):
            # a bucket goes from its current side to the other one, a new one to side 0
            mine = [b for b in touched if 1 - side.get(b, 1) == now]
            if mine:
                part = rows.filter(F.col("bucket").isin(mine)).hint("rebalance", "bucket")
                writer = part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                writer.partitionBy("bucket").parquet(f"{path}/side-{now}")
    finally:
        changed.unpersist()
    after = {**side, **{b: 1 - side.get(b, 1) for b in touched}}
    if after:
        listed = spark.createDataFrame([(b, s, number) for b, s in sorted(after.items())], MANIFEST)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest-{number % 2}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every state."""
    return _current(spark, path, manifest(spark, path)).drop("bucket")
