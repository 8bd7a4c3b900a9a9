"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: t bins. In round i every shingle is thrown into one bin, in the first t rounds a random one, in round t + j
always bin j; a bin keeps the smallest (round, hash) it saw. After round 2t no bin can be empty, usually all are filled
after a few rounds, and the share of equal bins of two sets is concentrated around their Jaccard similarity.

Documents with equal shingle sets are one node. Nodes that agree in a whole band share a bucket; candidates are checked
on their full sets of shingles. A bucket never becomes a table of all its pairs: it is compared with its centre, and then only
members of different components meet, in blocks, where exact bounds do not rule them out (see ``links``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from pliego.llm.common import per_worker, slices, text_or_empty, unused
from pliego.llm.components import components
from pliego.session import kept

WORDS = 5
PERCENT = 85  # similarity that links two documents
BANDS, BAND = 24, 5  # a pair at 0.85 is missed with probability (1 - 0.85^5)^24 < 1e-6
FEW, MANY = 256, 1024  # members of a bucket that meet in one cell

SKETCHES = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, without words none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and the six ASCII white spaces only
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    total = np.full(n, len(found) if len(found) < words else words, np.uint64)
    for i in range(min(words, len(found))):
        total = mixed(total + each[i : i + n] * ODD[i % len(ODD)] + ODD[-1])
    return np.unique(total)


def digest(items: bytes) -> bytes:
    return hashlib.blake2b(items, digest_size=16).digest()


def sketch(items: np.ndarray, bins: int = BANDS * BAND) -> np.ndarray:
    """Fast similarity sketch of a set of distinct 64-bit hashes that is not empty."""
    out = np.full(bins, ~np.uint64(0), np.uint64)
    step = max(1, min(bins, -(-bins * 6 // items.size)))  # rounds that most often fill all bins
    done = 0
    while done < bins and (done == 0 or (out == ~np.uint64(0)).any()):
        rounds = np.arange(done, min(bins, done + step), dtype=np.uint64)[:, None]
        value = mixed(items[None, :] + mixed(rounds + np.uint64(1)) * ODD[1])
        where = (value >> np.uint64(40)) % np.uint64(bins)
        np.minimum.at(out, where.ravel().astype(np.int64), ((rounds << np.uint64(48)) | (value & np.uint64((1 << 40) - 1))).ravel())
        done += step
    for j in np.flatnonzero(out == ~np.uint64(0)):
        value = mixed(items + mixed(np.uint64([bins + j + 1])) * ODD[1]) & np.uint64((1 << 40) - 1)
        out[j] = (np.uint64(bins + j) << np.uint64(48)) | value.min()
    return out


def bands(of: np.ndarray) -> list[int]:
    """One 64-bit key per band."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in of.reshape(BANDS, BAND).T:
        keys = mixed(keys * ODD[0] + column)
    return keys.view(np.int64).tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set of shingles and band keys (both null for an empty set) of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker("word hashes", _WordHashes)
        for batch in slices(batches, "text"):
            sizes, digests, keys = [], [], []
            for text in batch.column("text").to_pylist():
                items = shingles(text, hashes)
                sizes.append(items.size)
                digests.append(digest(items.tobytes()) if items.size else None)
                keys.append(bands(sketch(items)) if items.size else None)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scan, SKETCHES)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items): the shingles of the wanted nodes, computed again from their texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker("word hashes", _WordHashes)
        for batch in slices(batches, "text"):
            items = [shingles(text, hashes).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("node"), pa.array(map(digest, items), pa.binary()), pa.array(items, pa.binary())], names=["node", "digest", "items"]
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), text_or_empty().alias("text"))
    # the hint keeps the plan the same at every size
    found = texts.join(wanted.hint("merge"), "node", "left_semi").mapInArrow(scan, "node bigint, digest binary, items binary").filter("length(items) > 0")
    return found.groupBy("node").agg(F.min(F.struct("digest", "items")).alias("least")).select("node", "least.items")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with the sizes of intersection and union of their sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (x, y) if x.size < y.size else (y, x)
                at = np.minimum(np.searchsorted(large, small), large.size - 1)
                both.append(int((large[at] == small).sum()))
                either.append(x.size + y.size - both[-1])
            yield pa.record_batch(
                [batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"]
            )

    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(compare, "a bigint, b bigint, both bigint, either bigint")


def links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components (node, component) of the nodes that have a verified link to another node.

    First every bucket is compared with its smallest member, its centre, and the links found give components. A bucket of one
    component is done. In the others, members of different components have to meet, and two exact bounds rule out most of them
    without a comparison: a shingle that no other component has is in no common part, so a node with too few others links
    to nothing new, and two nodes share no more than the smaller number of others. What is left is compared bucket by bucket, in
    blocks of a bounded number of members, members outside the bucket's largest component with the rest, each pair in
    its first common bucket. So two members of a bucket are either compared, or ruled out, or connected.
    """
    bucket = ["band", "key"]
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("centre")).filter("members > 1")
    crowded = kept(keys.join(shared.drop("members"), bucket), "buckets")
    pairs = kept(crowded.filter("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    sets = kept(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    linked = f"100 * both >= {percent} * either"
    stars = kept(_compared(pairs, sets), "stars")
    labels = kept(components(stars.filter(linked)), "labels")
    if stars.filter(f"not ({linked})").isEmpty():
        return labels
    now = labels.select("node", F.col("component").alias("label"))
    named = crowded.drop("centre").join(now, "node", "left").withColumn("label", F.coalesce("label", "node"))
    opened = kept(_of_several(named), "open")
    shingled = _shingles(sets.join(opened.select("node", "label").distinct(), "node"))
    common = shingled.groupBy("item").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("item")
    outward = shingled.join(common, "item").groupBy("node").agg(F.collect_list("item").alias("items"))
    sizes = sets.select("node", (F.length("items") / 8).cast("bigint").alias("n"))
    able = kept(outward.join(sizes, "node").filter(f"100 * size(items) >= {percent} * n"), "able")
    left = _of_several(opened.join(able.select("node"), "node", "left_semi"))
    found = _met(kept(left, "left"), able.join(nodes, "node"), percent)
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return kept(components(found.union(known)), "labels")


def _of_several(members: DataFrame) -> DataFrame:
    """The members (band, key, node, label) of buckets with more than one label."""
    several = members.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return members.join(several.select("band", "key"), ["band", "key"], "left_semi")


def _shingles(sets: DataFrame) -> DataFrame:
    """(node, label, item): one row per shingle of the sets (node, items, label)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                items = [np.frombuffer(v.as_buffer(), np.int64) for v in some.column("items")]
                rows = np.repeat(np.arange(len(items)), [len(x) for x in items])
                columns = [some.column(c).take(pa.array(rows)) for c in ("node", "label")]
                yield pa.record_batch([*columns, pa.array(np.concatenate(items))], names=["node", "label", "item"])

    return sets.select("node", "label", "items").mapInArrow(explode, "node bigint, label bigint, item bigint")


def _met(members: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (band, key, node, label) of a bucket with different labels, as many as it takes to connect
    what is linked. ``able`` holds their n, bands and the items they share with other components."""
    by_label = members.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    state = by_label.groupBy("band", "key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    state = state.select(
        "band", "key", F.col("top.label").alias("top"),
        F.ceil((F.col("all") - F.col("top.n")) / FEW).cast("int").alias("rows"), F.ceil(F.col("all") / MANY).cast("int").alias("columns"),
    )
    placed = members.join(state, ["band", "key"])
    cell = ["band", "key", "row", "column"]

    def copies(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        mine = side.withColumn(own, F.pmod(F.xxhash64("node"), F.col(own_n)).cast("int"))
        spread = mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).select(*cell, "node", "label", "top")
        full = spread.join(able, "node")
        return full.select(*[F.col(c).alias(c) for c in [*cell, "node", "label", "top", "n", "bands", "items"]])

    few = copies(placed.filter("label <> top"), "row", "rows", "column", "columns")
    many = copies(placed, "column", "columns", "row", "rows")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            band = left.column("band")[0].as_py()
            top = left.column("top")[0].as_py()
            (x, of_x, nx, bx, ix), (y, of_y, ny, by, iy) = (_columns(t) for t in (left, right))
            sx, sy = (np.array([len(i) for i in items]) for items in (ix, iy))
            joined: dict[int, int] = {}  # components of this cell that were found to be one

            def root(label: int) -> int:
                while label in joined:
                    label = joined[label]
                return label

            for i in range(len(x)):
                most = np.minimum(sx[i], sy)
                near = (of_y != of_x[i]) & (100 * most >= percent * (nx[i] + ny - most)) & ((of_y == top) | (x[i] < y))
                near[near] &= (by[near] == bx[i]).argmax(axis=1) == band  # the first bucket both are in
                for j in np.flatnonzero(near).tolist():
                    one, other = root(int(of_x[i])), root(int(of_y[j]))
                    if one != other:
                        small, large = (ix[i], iy[j]) if sx[i] < sy[j] else (iy[j], ix[i])
                        at = np.minimum(np.searchsorted(large, small), large.size - 1)
                        both = int((large[at] == small).sum())
                        if 100 * both >= percent * (nx[i] + ny[j] - both):
                            joined[max(one, other)] = min(one, other)
                            found.append((int(x[i]), int(y[j])))
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return few.groupBy(*cell).cogroup(many.groupBy(*cell)).applyInArrow(meet, "a bigint, b bigint")


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    node, label, n = (np.asarray(table.column(c)) for c in ("node", "label", "n"))
    bands = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
    return node, label, n, bands, [np.sort(v.values.to_numpy()) for v in table.column("items")]


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of documents (doc_id, text).

    Null, empty and blank texts have no shingles and are linked with nothing. Rows without doc_id are linked with nothing
    and have no component, but are kept. Rows that share a doc_id are one document, compared by the set with the
    smallest digest and by exact copies of the others; repeated rows are returned each. The smallest doc_id of equals is kept.
    A very long text counts with its whole set of shingles, which one task holds in memory.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = kept(sketches(docs), "sketches")
    full = rows.filter("digest is not null and doc_id is not null")
    sets = full.groupBy("digest").agg(F.min("doc_id").alias("node"))
    one = full.join(sets.select("node", F.col("digest").alias("_d")), F.col("digest") == F.col("_d")).filter("doc_id = node")
    nodes = kept(one.groupBy("node").agg(F.min(F.struct("digest", "bands")).alias("least")).select("node", "least.bands"), "nodes")
    labels = links(docs, nodes, percent)
    # a document whose rows have different texts ties their sets together
    several = full.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("doc_id")
    ties = full.join(several, "doc_id", "left_semi").join(sets, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    if not ties.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(ties))
    named = sets.join(labels, "node", "left").select(F.col("digest").alias("_d"), F.coalesce("component", "node").alias("component_id"))
    joined = rows.join(named, (F.col("digest") == F.col("_d")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each component left; rows without doc_id stay; columns unchanged.

    Of rows that share a doc_id one stays, the one with the smallest text."""
    stays = unused(docs, "_stays")
    stay = near_duplicates(docs, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias(stays)).distinct()
    place = unused(docs, "_place")
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first()))
    with_id = docs.filter(F.col("doc_id").isNotNull()).withColumn(place, first).filter(F.col(place) == 1).drop(place)
    kept_ids = with_id.join(kept(stay, "stay"), F.col("doc_id").cast("bigint") == F.col(stays), "left_semi")
    return kept_ids.unionByName(docs.filter(F.col("doc_id").isNull()))
