"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares two short strings by the subsequences of three to five characters they share, contiguous or with a few
characters in between; every skipped character halves a subsequence's weight. So ``id.i*ot`` stays near ``idiot``. A string
is a word with its punctuation, with a mark at its start; runs of single characters (``i d i o t``) count as one more word.
Gaps are bounded, so the kernel is a scalar product of sparse vectors, and the score of a word against all landmarks is one
sum over its subsequences.

Landmarks are words of the labelled sentences. Their kernel matrix gives the Nyström features, on which a linear support
vector machine with squared hinge loss separates the words that make sentences toxic from the words of clean ones: as only
whole texts are labelled, the words of a toxic text that count as toxic are chosen anew from the last model's scores.
A text is scored by its highest word scores and their number, through a logistic function fitted on the same rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pliego.llm.common import give_back, per_worker, slices, text_or_empty

SAMPLE = 2_000  # labelled rows of each class used at most
LANDMARKS = 400
DECAY = 0.5
SPANS = {3: 5, 4: 6, 5: 6}  # length of a subsequence: characters it may stretch over
BITS = 22
WINDOW = 24  # longer strings are scored by overlapping windows
THRESHOLD = 0.7
SCORED, PART, FEATURES = 10_000, 1_000, 4_000  # words scored, training rows copied, and features of landmarks held, at once
SURE = 0.5  # log odds, less two standard errors, from which a word is first taken as toxic
CACHED_WORDS = 400_000
SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
START = 63

SHAPES = [(0, *rest) for p, span in SPANS.items() for rest in combinations(range(1, span), p - 1)]


def _codes() -> np.ndarray:
    """By code point below 65536: 1 to 26 for a to z, 27 to 62 for other letters, 0 for what is only a gap."""
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c % 36
    return table


class Kernel:
    """Sparse vectors of strings."""

    def __init__(self) -> None:
        self.codes = _codes()

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all windows of all words with zeros between, first place of each window, word of each window."""
        windows, owner = [], []
        for n, word in enumerate(words):
            word = word.strip(EDGES)
            for at in range(0, max(1, len(word) - WINDOW // 2), WINDOW // 2) if len(word) > WINDOW else (0,):
                windows.append(word[at : at + WINDOW])
                owner.append(n)
        text = "".join("\x01" + w + "\x00" * 6 for w in windows)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes[np.minimum(points, 0xFFFF)].astype(np.uint64)
        codes[points == 1] = START
        lengths = np.fromiter(map(len, windows), np.int64, len(windows)) + 7
        return codes, np.cumsum(lengths) - lengths, np.array(owner, np.int64)

    @staticmethod
    def shape(codes: np.ndarray, at: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The hashed subsequence that starts at each place, and whether there is one."""
        n = codes.size - 6
        key, there = codes[:n].copy(), codes[:n] > 0
        for k in at[1:]:
            key = (key << np.uint64(6)) | codes[k : n + k]
            there &= codes[k : n + k] > 0
        return ((key + np.uint64(len(at) << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS), there

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, feature, weight) of all windows, scaled so that a string without repeats has length one."""
        codes, first, _ = self.flat(words)
        window = np.repeat(np.arange(first.size), np.diff([*first, codes.size]))[: codes.size - 6]
        rows, keys, weights = [], [], []
        for at in SHAPES:
            key, there = self.shape(codes, at)
            rows.append(window[there])
            keys.append(key[there])
            weights.append(np.full(int(there.sum()), DECAY ** (at[-1] + 1 - len(at))))
        rows, keys, weights = np.concatenate(rows), np.concatenate(keys).astype(np.int64), np.concatenate(weights)
        norm = np.sqrt(np.maximum(np.bincount(rows, weights * weights, first.size), 1e-9))
        return rows, keys, weights / norm[rows]

    def scores(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Per word, the largest scaled sum of table values over a window."""
        if len(words) > SCORED:
            return np.concatenate([self.scores(words[at : at + SCORED], table) for at in range(0, len(words), SCORED)])
        out = np.full(len(words), -np.inf)
        if not words:
            return out
        codes, first, owner = self.flat(words)
        total, norm = np.zeros(codes.size), np.zeros(codes.size)
        for at in SHAPES:
            key, there = self.shape(codes, at)
            weight = DECAY ** (at[-1] + 1 - len(at))
            total[: there.size] += weight * (table[key] * there)
            norm[: there.size] += weight * weight * there
        sums = np.add.reduceat(total, first) / np.sqrt(np.maximum(np.add.reduceat(norm, first), 1e-9))
        np.maximum.at(out, owner, sums)
        return out


@dataclass
class Model:
    """Feature weights of the word scorer (sparse), its offset and the logistic function over texts."""

    keys: np.ndarray
    values: np.ndarray
    offset: float
    text: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def words_of(text: str) -> list[str]:
    """Lower-case words between white space, and runs of single characters as further words."""
    text = text.lower()
    found = text.split()
    if " " in text:
        found += [run.replace(" ", "") for run in SPACED.findall(text)]
    return found


def text_features(scores: np.ndarray) -> np.ndarray:
    """Of the word scores of a text: the three highest, how many are toxic, also by length, and the length."""
    if not scores.size:
        scores = np.full(1, -1.0)
    top = np.sort(np.partition(scores, max(0, scores.size - 3))[-3:])[::-1]
    top = np.concatenate([top, np.full(3 - top.size, -1.0)])
    hits = float((scores > 0).sum())
    return np.array([*np.clip(top, -1.5, 1.5), np.log1p(hits), np.sqrt(hits / scores.size), np.log1p(scores.size)])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Squared hinge loss with a ridge, by Newton steps on the active rows; the last coefficient is the offset."""
    width = x.shape[1] + 1
    w = np.zeros(width)
    eye = np.eye(width) * ridge
    eye[-1, -1] = 1e-6
    for _ in range(30):
        active = np.flatnonzero(y * (x @ w[:-1] + w[-1]) < 1)
        left, right = eye.copy(), np.zeros(width)
        for at in range(0, len(active), PART):  # rows are copied a part at a time
            mine = active[at : at + PART]
            part = np.column_stack([x[mine], np.ones(len(mine))])
            weighted = part.T * weight[mine]
            left += weighted @ part
            right += weighted @ y[mine]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _counted(texts: list[str], toxic: list[int]) -> tuple[list[str], list[np.ndarray], np.ndarray, np.ndarray]:
    """All words that are looked at, those of each toxic text, and in how many toxic and clean texts each stands."""
    number: dict[str, int] = {}
    members = []  # words of the toxic texts, each once
    pairs = []  # words with the word before them
    for text, y in zip(texts, toxic):
        if y:
            found = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int64)
            members.append(np.unique(found))
            pairs.append(np.unique(found[1:] << 32 | found[:-1]))
    # copies of a text say nothing new: a word counts once per word it follows, and once per text
    contexts = np.unique(np.concatenate(pairs)) >> 32
    bad = np.minimum(np.bincount(np.concatenate(members), minlength=len(number)), np.bincount(contexts, minlength=len(number)))
    seen: Counter[int] = Counter()
    for text, y in zip(texts, toxic):
        if not y:  # of the words that only clean texts have, a quarter is enough
            for w in dict.fromkeys(words_of(text)):
                if w in number or zlib.crc32(w.encode("utf-8", "surrogatepass")) % 4 == 0:
                    seen[number.setdefault(w, len(number))] += 1
    bad = np.append(bad, np.zeros(len(number) - bad.size, np.int64))
    good = np.zeros(len(number), np.int64)
    good[list(seen)] = list(seen.values())
    return list(number), members, bad, good


class Landmarks:
    """Sparse vectors of the marks, by feature, and the root that turns products with them into Nyström features."""

    def __init__(self, kernel: Kernel, marks: list[str]) -> None:
        rows, keys, weights = kernel.vectors(marks)
        self.kernel, self.marks = kernel, len(marks)
        self.names, keys = np.unique(keys, return_inverse=True)
        order = np.argsort(keys, kind="stable")
        self.rows, self.keys, self.weights = rows[order], keys[order], weights[order]
        self.first = np.searchsorted(self.keys, np.arange(self.names.size + 1))
        alike = np.zeros((self.marks, self.marks))
        for at in range(0, self.names.size, FEATURES):
            part = self.dense(at)
            alike += part @ part.T
        values, vectors = np.linalg.eigh(alike)
        self.root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])

    def dense(self, at: int) -> np.ndarray:
        """The marks' vectors in the features from ``at``."""
        first, last = np.searchsorted(self.keys, [at, at + FEATURES])
        part = np.zeros((self.marks, min(FEATURES, self.names.size - at)))
        np.add.at(part, (self.rows[first:last], self.keys[first:last] - at), self.weights[first:last])
        return part

    def nystroem(self, words: list[str]) -> np.ndarray:
        """Nyström features, by the words' products with the marks: no feature of a mark is held for all columns of the root."""
        out = np.zeros((len(words), self.root.shape[1]))
        for at in range(0, len(words), 25):
            part = [w.strip(EDGES)[:WINDOW] for w in words[at : at + 25]]
            r, k, w = self.kernel.vectors(part)
            place = np.searchsorted(self.names, k)
            place[place == self.names.size] = 0
            known = self.names[place] == k
            r, place, w = r[known], place[known], w[known]
            n = self.first[place + 1] - self.first[place]  # marks with the feature
            mine = np.arange(n.sum()) + np.repeat(self.first[place] - np.cumsum(n) + n, n)
            pair = np.repeat(r, n) * self.marks + self.rows[mine]
            products = np.bincount(pair, np.repeat(w, n) * self.weights[mine], len(part) * self.marks)
            out[at : at + len(part)] = products.reshape(len(part), self.marks) @ self.root
        return out

    def values(self, w: np.ndarray) -> np.ndarray:
        """Weights of the marks' features, from those of the Nyström features."""
        return np.bincount(self.keys, self.weights * (self.root @ w)[self.rows], self.names.size)


def _words(texts: list[str], toxic: list[int], landmarks: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The word scorer: features, their values and the offset."""
    rng, kernel = np.random.default_rng(seed), Kernel()
    vocabulary, members, bad, good = _counted(texts, toxic)
    n_bad, n_good = sum(toxic), len(toxic) - sum(toxic)
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    odds[bad < 3] = np.minimum(odds[bad < 3], 0.0)
    best = np.argsort(-odds * np.sqrt(bad), kind="stable")[: landmarks // 2]
    rest = rng.choice(len(vocabulary), min(len(vocabulary), landmarks - best.size), replace=False, p=(bad + good) / (bad + good).sum())
    marks = Landmarks(kernel, [vocabulary[i][:WINDOW] for i in dict.fromkeys([*best.tolist(), *rest.tolist()])])

    def separated(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
        """Coefficients of the support vector machine; its rows are gone when words are scored."""
        x = marks.nystroem([vocabulary[i] for i in [*positive.tolist(), *negative.tolist()]])
        y = np.concatenate([np.ones(positive.size), -np.ones(negative.size)])
        weight = np.concatenate([np.sqrt(bad[positive]), np.sqrt(1 + good[negative])])
        weight *= np.where(y > 0, len(y) / (2 * weight[y > 0].sum()), len(y) / (2 * weight[y < 0].sum()))
        return _svm(x, y, weight, ridge=1.0)

    values, offset = np.zeros(marks.names.size), -1.0
    seldom = np.where(bad + good < 8, -0.5, 2 * SURE)  # a word seen often must speak for itself
    doubt = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    score = odds - 2 * doubt  # the first choice of toxic words
    clean = np.flatnonzero(good)
    for turn in range(rounds):
        chosen: set[int] = set()
        for m in members:
            top = m[np.argsort(-score[m], kind="stable")[:6]]
            least = np.where(bad[top] + good[top] < 8, 0.5, 0.0) if turn else SURE
            chosen.update(top[(score[top] > least) & (odds[top] > seldom[top])].tolist())
        hard = clean[np.argsort(-score[clean], kind="stable")[:3000]]
        easy = rng.choice(clean, min(clean.size, 9000), replace=False)
        negative = np.setdiff1d(np.union1d(hard, easy), np.fromiter(chosen, np.int64, len(chosen)))
        positive = np.array(sorted(chosen), np.int64)
        if not positive.size:
            break
        w = separated(positive, negative)
        values, offset = marks.values(w[:-1]), float(w[-1])
        if turn < rounds - 1:  # the last scores are not looked at
            table = np.zeros(1 << BITS)
            table[marks.names] = values
            score = kernel.scores(vocabulary, table) + offset
            del table
    return marks.names, values, offset


def fit(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 4, seed: int = 7) -> Model:
    """Train on whole labelled texts. Without texts of both classes every text scores the share of toxic ones.

    What is counted, the rows of the machine and the words' scores are held one after the other, not together.
    """
    label = np.array(toxic, np.int64)
    if not len(texts) or label.min() == label.max():
        share = float(label.mean()) if len(texts) else 0.0
        flat = np.zeros(7)
        flat[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, flat, np.zeros(6), np.ones(6))
    names, values, offset = _words(texts, label.tolist(), landmarks, rounds, seed)
    give_back()
    model = Model(names, values, offset, np.zeros(7), np.zeros(6), np.ones(6))
    features = Scorer(model).features(texts)
    mean, scale = features.mean(0), features.std(0) + 1e-6
    text = _logistic((features - mean) / scale, label.astype(float))
    return Model(names, values, offset, text, mean, scale)


class Scorer:
    """Scores texts with a model; remembers word scores."""

    def __init__(self, model: Model):
        self.model, self.kernel, self.known = model, Kernel(), {}
        self.table = np.zeros(1 << BITS, np.float32)
        self.table[model.keys] = model.values

    def __call__(self, texts: list[str]) -> list[float]:
        m, x = self.model, self.features(texts)
        z = ((x - m.mean) / m.scale) @ m.text[:-1] + m.text[-1]
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

    def features(self, texts: list[str]) -> np.ndarray:
        """Text features of all texts, a few at a time."""
        parts = [self._some(texts[at : at + 64]) for at in range(0, len(texts), 64)]
        return np.concatenate(parts) if parts else np.zeros((0, 6))

    def _some(self, texts: list[str]) -> np.ndarray:
        bags = [words_of(t) for t in texts]
        missing = list({w for b in bags for w in b if w not in self.known})
        if len(self.known) + len(missing) > CACHED_WORDS:
            self.known = {}
            missing = list({w for b in bags for w in b})
        for at in range(0, len(missing), SCORED):
            part = missing[at : at + SCORED]
            self.known.update(zip(part, (self.kernel.scores(part, self.table) + self.model.offset).tolist()))
        known = self.known
        return np.array([text_features(np.fromiter(map(known.__getitem__, b), float, len(b))) for b in bags])


def scorer(name: str, shared) -> Scorer:
    """The scorer of a broadcast model, kept per worker process, so word scores are remembered from task to task."""
    return per_worker(f"scorer {name}", lambda: Scorer(shared.value))


def training_rows(docs: DataFrame, labels: DataFrame, allowed=None, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most ``sample`` labelled texts of each class, those with the smallest hashes of their ids.

    ``allowed`` is a condition on doc_id. Rows without a label, a doc_id or a text are not used; if a document has
    several labels it counts as toxic when one says so.
    """
    named = labels.filter("doc_id is not null and toxic is not null")
    if allowed is not None:
        named = named.filter(allowed)
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = None
    for one in (0, 1):
        part = named.filter(F.col("toxic") == one).orderBy(order, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    rows = (
        docs.filter(F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows
        .orderBy("doc_id", "text")
        .limit(2 * sample)
        .toPandas()
    )
    return rows["text"].tolist(), rows["toxic"].astype(int).tolist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row; null texts score as empty ones, repeated rows are returned each, alike.

    A very long text counts whole, by one task that holds it in memory; long words are scored by overlapping windows. Rows
    without doc_id are returned; other columns are ignored; an empty table gives no rows.
    """
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_all = scorer(name, shared)
        for batch in slices(batches, "text", 1 << 20):
            scores = score_all(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold; columns unchanged, nulls included."""
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        score_all, found = scorer(name, shared), []
        for at in range(0, len(texts), 64):
            found += score_all(texts.iloc[at : at + 64].tolist())
        return pd.Series(found, dtype="float64")

    return docs.filter(scored(text_or_empty()) < threshold)
