"""Language of whole texts by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, a logistic regression on hashed character n-grams of the whole
text, learns which half of the languages a text belongs to. Decoding is weighted by loss: a language's cost is the logistic
loss of all bits against its codeword, each bit weighted by how well it knew that language on texts kept from the training.
The cheapest codeword is the language; a text whose bits lie farther from it than the code can correct, or whose
second codeword is nearly as cheap, is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from pliego.llm.common import slices

UNKNOWN = "und"
BUCKETS = 1 << 13
GRAMS = 3  # characters of the longest n-grams
SAMPLE, LEAST_SAMPLE = 3_000, 60  # training texts of all languages together, and of each one at least
SEGMENT = 1 << 16  # characters counted at once
ROUNDS, DECAY = 300, 1e-4
SURE = 0.6  # share of the winner below which a text is ambiguous
ROWS = 128  # texts scored together

_OTHER = re.compile(r"[\W\d_]+")
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def letters(text: str) -> str:
    """Lower-case words between single blanks; empty if there is no letter."""
    words = _OTHER.sub(" ", text.lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


def gram_counts(plain: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket of hashed n-grams of one to ``GRAMS`` characters occurs."""
    total = np.zeros(buckets, np.int64)
    for at in range(0, len(plain), SEGMENT):
        some = np.frombuffer(plain[at : at + SEGMENT + GRAMS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.zeros(len(some), np.uint32)
        for n in range(1, GRAMS + 1):
            code = (code[: len(some) - n + 1] + some[n - 1 :] * _ODD[n - 1]) * _ODD[0]
            code ^= code >> np.uint32(15)
            starts = code[: min(SEGMENT, len(plain) - at - n + 1)] if len(code) else code
            total += np.bincount((starts * _ODD[1]) >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets)
    return total


def features(plain: str) -> np.ndarray:
    """Square roots of the shares of all buckets: a vector of length one for texts of every size."""
    counts = gram_counts(plain)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of -1 and 1: all different splits for few languages, else random ones with the best separation."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    rng, bits, best = np.random.default_rng(1), int(np.ceil(12 * np.log2(n))), None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=0, dtype=np.int64)) < n]  # every bit splits the languages
        apart = separation(code)
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def separation(code: np.ndarray) -> int:
    """The least number of bits in which two codewords differ."""
    same = code.astype(np.int64) @ code.T.astype(np.int64)
    np.fill_diagonal(same, -code.shape[1])
    return int((code.shape[1] - same.max()) // 2)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (buckets + 1, bits), the last row for the constant
    trust: np.ndarray  # (languages, bits), rows add up to one


def _margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (x @ weights[:-1] + weights[-1]).astype(np.float64)


def fit(x: np.ndarray, of: np.ndarray, languages: list[str], rounds: int = ROUNDS) -> Model:
    """Classifiers for feature rows ``x`` of the languages numbered ``of``. Each fifth row of a language says how far its bits
    are trusted; the others train them, each language with the same weight in all."""
    code = codewords(len(languages))
    place = np.zeros(len(of), np.int64)
    for c in range(len(languages)):
        place[of == c] = np.arange((of == c).sum())
    train = (place % 5 != 4)
    many = np.maximum(1, np.bincount(of[train], minlength=len(languages)))
    share = (1 / many[of[train]] / max(1, len(languages))).astype(np.float32)[:, None]
    a, y = x[train], code[of[train]].astype(np.float32)
    w = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    ahead, step = w.copy(), np.float32(4 / 2)  # rows have length one and a constant: the loss bends by a half at most
    for r in range(rounds if code.shape[1] else 0):  # accelerated gradient descent
        slope = -y * share / (1 + np.exp(np.clip(y * _margins(a, ahead), -30, 30)))
        slope = slope.astype(np.float32)
        move = np.vstack([a.T @ slope, slope.sum(axis=0)]) + np.float32(DECAY) * ahead
        new = ahead - step * move
        ahead = new + np.float32(r / (r + 3)) * (new - w)
        w = new
    known = np.ones(code.shape)
    held, right = of[~train], None
    if len(held) and code.shape[1]:
        right = _margins(x[~train], w) * code[held] > 0
        for c in np.unique(held):
            known[c] = (right[held == c].sum(axis=0) + 1) / ((held == c).sum() + 2)
    return Model(languages, code, w, known / np.maximum(known.sum(axis=1, keepdims=True), 1e-12))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, share of the winner, whether it is ambiguous) of each row; equal costs go to the first language."""
    if len(model.languages) == 1:
        return np.zeros(len(margins), np.int64), np.ones(len(margins)), np.zeros(len(margins), bool)
    loss = np.logaddexp(0, -margins[:, None, :] * model.code[None, :, :])
    cost = (loss * model.trust[None, :, :]).sum(axis=2)
    best = cost.argmin(axis=1)
    bits = model.code.shape[1]
    share = np.exp(-(cost - cost.min(axis=1, keepdims=True)) * bits / 2)
    top = 1 / share.sum(axis=1)
    wrong = (np.where(margins > 0, 1, -1) != model.code[best]).sum(axis=1)
    return best, top, (wrong > (separation(model.code) - 1) // 2) | (top < SURE)


def training_rows(docs: DataFrame, allowed: Column, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Feature rows, language numbers and languages of a bounded sample of the documents (text, lang) that ``allowed`` keeps:
    of each language the texts with the smallest hashes, ``sample`` in all languages together but ``LEAST_SAMPLE`` of each at
    least. Only hashes are compared to choose; whole texts are counted in the tasks, and their counts come to the driver."""
    rows = docs.filter(F.coalesce(allowed, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    hashes = rows.select("lang", "h").distinct()
    each = max(LEAST_SAMPLE, sample // max(1, rows.select("lang").distinct().count()))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    chosen = hashes.withColumn("place", place).filter(F.col("place") <= each).select("lang", "h")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [gram_counts(letters(text)) for text in batch.column("text").to_pylist()]
            used = [np.flatnonzero(c) for c in found]
            yield pa.record_batch(
                [
                    batch.column("lang"),
                    batch.column("h"),
                    pa.array([u.astype("<i4").tobytes() for u in used], pa.binary()),
                    pa.array([c[u].astype("<i8").tobytes() for c, u in zip(found, used)], pa.binary()),
                ],
                names=["lang", "h", "used", "counts"],
            )

    # at most sample rows, or LEAST_SAMPLE per language, are chosen, so their keys are small enough to go to all tasks
    some = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").mapInArrow(count, "lang string, h bigint, used binary, counts binary")
    found = some.groupBy("lang", "h").agg(F.min(F.struct("used", "counts")).alias("m")).select("lang", "h", "m.*").toArrow()
    found = found.sort_by([("lang", "ascending"), ("h", "ascending")]) if found.num_rows else found
    x = np.zeros((found.num_rows, BUCKETS), np.float32)
    for i, (used, counts) in enumerate(zip(found["used"], found["counts"])):
        n = np.frombuffer(counts.as_py(), "<i8")
        x[i, np.frombuffer(used.as_py(), "<i4")] = np.sqrt(n / max(1, n.sum()))
    spoken = x.any(axis=1)  # texts without a letter teach nothing
    names = np.array(found["lang"].to_pylist(), object)[spoken]
    learned = sorted(set(names.tolist()))
    number = {name: i for i, name in enumerate(learned)}
    return x[spoken], np.array([number[n] for n in names], np.int64), learned


def train(docs: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    return fit(*training_rows(docs, allowed, sample))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """lang_pred, score, ambiguous of each row of documents (text), beside all its other columns but text.

    The whole text counts, however long; one task holds it in memory; its features have the same length for every size. A text that is null or has no letter is ``und``
    with score 0 and ambiguous, and so is every text if no language was learned. A score is the winner's share of all
    languages, from 0 to 1. Every row is judged for itself, repeated ones alike; columns with the names of the new ones are
    replaced; an empty table gives no rows."""
    made = ["lang_pred", "score", "ambiguous"]
    others = [c for c in docs.columns if c.lower() not in [*made, "text"]]
    parts = (model.languages, model.code, model.weights, model.trust)  # plain values: executors have no copy of this package
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in slices(batches, "text"):
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                plain = [letters(text or "") for text in some.column("text").to_pylist()]
                spoken = np.array([bool(p) and bool(known.languages) for p in plain], bool)
                names = np.full(len(plain), UNKNOWN, object)
                score, ambiguous = np.zeros(len(plain)), np.ones(len(plain), bool)
                if spoken.any():
                    x = np.stack([features(p) for p, good in zip(plain, spoken) if good])
                    best, score[spoken], ambiguous[spoken] = decode(known, _margins(x, known.weights))
                    names[spoken] = np.array(known.languages, object)[best]
                made_columns = [pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(ambiguous)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in others), *made_columns], names=[*others, *made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in others]).schema)
    schema = f"{fields}{', ' if fields else ''}lang_pred string, score double, ambiguous boolean"
    return docs.select(*[f"`{c}`" for c in others], F.col("text")).mapInArrow(scan, schema)
