"""Centroid clustering, collocations and language identification beside plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pliego.llm import centroids, languages, phrases
from pliego.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


# centroids


def clustered(rows, width, k, rounds, seed=1):
    """(vec_id, cluster, distance) of each usable row, the distance sums and the centroids, with Python integers only."""
    fine = [(i, [math.floor(64 * v) for v in x]) for i, x in rows if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in fine if i is not None)[:k]
    centres = [x for _, x in start]

    def assign():
        out = []
        for i, x in fine:
            d, c = min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(centres))
            out.append((i, c, d, x))
        return out

    for _ in range(rounds if centres else 0):
        groups = defaultdict(list)
        for _, c, _, x in assign():
            groups[c].append(x)
        for c, xs in groups.items():
            centres[c] = [sum(col) // len(xs) for col in zip(*xs)]
    return (assign() if centres else []), centres


def check_clusters(spark, rows, width=4, k=3, rounds=3):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.withColumns({"cluster": F.lit("x"), "x": F.lit(1), "distance": F.lit(0)})
    got = centroids.cluster(df, width=width, k=k, rounds=rounds).collect()
    want, centres = clustered(rows, width, k, rounds)
    longest = centroids.LONGEST
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter((i, c, min(d, longest)) for i, c, d, _ in want)
    sums = defaultdict(int)
    for _, c, d, _ in want:
        sums[c] += min(d, longest)
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (min(sums[r.cluster], longest), min(sum(sums.values()), longest))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
    return got


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_rounds(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 4, 0.4) for _ in range(4)]) for i in range(200)]
    rows += [(1, rows[1][1]), (None, [0.5] * 4), (500, None), (501, [1.0, None, 0.0, 0.0]), (502, [1.0]), (503, [math.nan] * 4), (504, [math.inf, 0.0, 0.0, 0.0])]
    assert len(check_clusters(spark, rows)) == 202


def test_equally_near_and_empty_clusters(spark):
    check_clusters(spark, [(i, [float(i % 2)] * 4) for i in range(12)], k=5)  # several first centroids are the same point
    check_clusters(spark, [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(7)], k=3)
    check_clusters(spark, [(1, [0.0] * 4), (2, [1.0] * 4)], k=16)


def test_components_of_any_size(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 5, 9, 30, 300]) for _ in range(3)]) for i in range(60)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), width=3, k=4, rounds=0).collect()
    want, _ = clustered(rows, 3, 4, 0)
    assert {(r.vec_id, r.cluster, r.distance) for r in got} == {(i, c, min(d, centroids.LONGEST)) for i, c, d, _ in want}
    check_clusters(spark, [(i, [rng.uniform(-1, 1) * 10**7 for _ in range(4)]) for i in range(80)])


def test_tables_without_usable_vectors(spark):
    assert check_clusters(spark, [(1, None), (2, [1.0])]) == []
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert centroids.cluster(empty).columns == Q.op11_lookup_clusters(spark, SMALL).columns
    assert check_clusters(spark, [(None, [1.0] * 4)]) == []


def test_tables_of_values_are_the_same_for_few_and_many_values():
    rng = np.random.default_rng(2)
    for spread in (3, 10**6):
        x = rng.integers(-spread, spread, (200, 5))
        best, distance = centroids.nearest(x, x[:7])
        plain = ((x[:, None, :] - x[None, :7, :]) ** 2).sum(2)
        assert (best == plain.argmin(1)).all() and (distance == plain.min(1)).all()


# phrases


def plain_phrases(docs, order=3, least=10, best=2000, share=50):
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, order + 1):
                for i in range(len(words) - m + 1):
                    count[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, p), f in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * f >= share * count[lang, p[i : i + m]]:
                    hidden.add((lang, p[i : i + m]))
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        if (lang, p) not in hidden:
            cuts = []
            for k in range(1, len(p)):
                l, r = count[lang, p[:k]], count[lang, p[k:]]
                cuts.append((1_000_000 * a * a // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {
        (lang, rank, p.decode(), -a, l, r, total[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:best], 1)
    }


WORDS = ["a", "B", "é", "É", " ", "\x1f", "ab-c", "the", "of", " x", "z\x00", "𐐀"]


def odd_texts(seed, n=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        joined = "".join(rng.choice(WORDS[: rng.randint(2, 12)]) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", "\x0b", " "]) for _ in range(rng.randint(0, 120)))
        texts.append((rng.choice(["en", "de", None, "und", "", "x y"]), joined))
    return [*texts, ("en", None), ("en", ""), (None, " \t. "), ("en", "the of " * 3000), ("xx", "alone")]


def found_phrases(spark, docs, **how):
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit(1) for c in ("n", "words", "bucket", "phrase", "doc_id")})
    return {tuple(r) for r in phrases.collocations(df.repartition(5), **how).collect()}


@pytest.mark.parametrize("how", [{}, {"order": 2, "least": 3}, {"order": 4, "least": 5, "best": 7}])
def test_phrases_equal_plain_counts(spark, how):
    docs = odd_texts(1)
    assert found_phrases(spark, docs, **how) == plain_phrases(docs, **how)


def test_texts_longer_than_a_block(spark, monkeypatch):
    """Windows across the borders of segments and blocks count once."""
    monkeypatch.setattr(phrases, "BLOCK", 50)
    monkeypatch.setattr(phrases, "SEGMENT", 40)
    monkeypatch.setattr(phrases, "BUCKET", 500)
    docs = odd_texts(2)
    assert found_phrases(spark, docs, least=4) == plain_phrases(docs, least=4)
    assert found_phrases(spark, docs, least=4, order=5) == plain_phrases(docs, least=4, order=5)


def test_one_pair_with_most_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET", 2000)
    rng = random.Random(4)
    docs = [("en", " ".join(f"of the w{rng.randint(0, 300)}" for _ in range(40))) for _ in range(100)]
    assert found_phrases(spark, docs) == plain_phrases(docs)
    rows = phrases.longest_windows(spark.createDataFrame(docs, "lang string, text string")).collect()
    assert sum(r.n for r in rows) == 100 * 120


def test_no_phrases(spark):
    assert found_phrases(spark, [("en", None), (None, "a b c")]) == set()
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_large_products_are_exact(spark, monkeypatch):
    """Counts of 10^12 give products of more than 64 bits."""
    big = 10**12 + 39
    rows = [("en", ["a", "b", "c"], big), ("en", ["a", "b", ""], 7), ("en", ["b", "c", ""], big + 1), ("en", ["c", "", ""], big + 2)]
    monkeypatch.setattr(phrases, "longest_windows", lambda docs, *a: spark.createDataFrame(rows, "lang string, words array<string>, n bigint"))
    got = {r.phrase: (r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(spark.createDataFrame([], "lang string, text string"), share=101).collect()}
    a, n = {"a": big + 7, "b": big + 1, "c": big + 2, "a b": big + 7, "b c": big + 1, "a b c": big}, sum(r[2] for r in rows)
    for p, k in (("a b", 1), ("b c", 1)):
        x, y = p.split(" ")
        assert got[p] == (a[p], a[x], a[y], n, 1_000_000 * a[p] ** 2 // (a[x] * a[y]))
    assert got["a b c"][4] == min(10**6 * big**2 // (a["a"] * a["b c"]), 10**6 * big**2 // (a["a b"] * a["c"]))


# languages


PARTS = {
    "en": ["the", "tion", "ing", "and", "er", "wh", "ould", "sh"],
    "de": ["der", "sch", "ung", "ein", "ä", "keit", "pf", "ü"],
    "fr": ["eau", "que", "è", "oi", "ment", "les", "é", "ç"],
    "es": ["ción", "ado", "ñ", "os", "el", "rr", "ll", "ía"],
    "it": ["zione", "gli", "ch", "are", "della", "gn", "ò", "to"],
    "pl": ["szcz", "ów", "nie", "rz", "ł", "ą", "cz", "prz"],
}


def spoken(rng, lang, words):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(words)) + "."


def sample(rng, n, names):
    return [(i, spoken(rng, names[i % len(names)], rng.randint(5, 60)), names[i % len(names)]) for i in range(n)]


@pytest.mark.parametrize("names", [["de", "en"], ["de", "en", "es", "fr"], sorted(PARTS)])
def test_held_out_languages(spark, names):
    rng = random.Random(3)
    docs = spark.createDataFrame(sample(rng, 90 * len(names), names), "doc_id bigint, text string, lang string")
    model = languages.train(docs, F.lit(True), sample=200)
    assert model.languages == sorted(names)
    new = spark.createDataFrame(sample(rng, 300, names), "doc_id bigint, text string, lang string")
    got = languages.identify(new, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 297 and all(0 <= r.score <= 1 for r in got)
    mixed = spoken(rng, names[0], 40) + spoken(rng, names[1], 40)
    pure = [languages.decode(model, languages._margins(languages.features(languages.letters(t))[None, :], model.weights)) for t in (mixed, spoken(rng, names[0], 80))]
    assert pure[0][1][0] < pure[1][1][0] and not pure[1][2][0]


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 20, 60):
        code = languages.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n and set(np.unique(code)) == {-1, 1}
        assert (np.abs(code.sum(axis=0, dtype=int)) < n).all()
        brute = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert languages.separation(code) == brute and (n < 4 or brute >= 4)


def test_wrong_bits_are_corrected_and_flagged():
    code = languages.codewords(4)
    model = languages.Model(list("abcd"), code, np.zeros((2, code.shape[1])), np.full(code.shape, 1 / code.shape[1]))
    for c in range(4):
        for bit in range(code.shape[1]):
            margins = 4.0 * code[c]
            margins[bit] *= -1
            best, _, ambiguous = languages.decode(model, margins[None, :])
            assert best[0] == c and not ambiguous[0]
    assert languages.decode(model, np.zeros((1, code.shape[1])))[2][0]


def test_counts_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(8)
    text = languages.letters(" ".join(spoken(rng, lang, 50) for lang in PARTS))
    whole = languages.gram_counts(text)
    assert whole.sum() == 3 * len(text) - 3
    for size in (1, 2, 3, 7, 100, len(text), len(text) + 1):
        monkeypatch.setattr(languages, "SEGMENT", size)
        assert (languages.gram_counts(text) == whole).all()
    assert languages.gram_counts("").sum() == 0 and languages.gram_counts("a").sum() == 1


def test_odd_rows_of_languages(spark):
    rng = random.Random(1)
    rows = [*sample(rng, 60, ["de", "en"]), (None, "the and", "en"), (900, None, "en"), (901, "", "de"), (902, "12 ?!_", "zz"), (903, "x" * 300_000, None), (1, "the", "en"), (1, "the", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"score": F.lit("s"), "ambiguous": F.lit(1), "h": F.lit(2)})
    model = languages.train(docs, F.col("doc_id") % 4 != 2)
    assert model.languages == ["de", "en"]  # zz has no letters
    got = languages.identify(docs, model)
    assert got.columns == ["doc_id", "lang", "h", "lang_pred", "score", "ambiguous"]
    kept = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    for i in (900, 901, 902):
        assert (kept[i].lang_pred, kept[i].score, kept[i].ambiguous) == ("und", 0, True)
    assert kept[903].lang_pred in ("de", "en")
    assert languages.identify(docs.filter("false"), model).collect() == []
    none = languages.train(docs.filter("false"), F.lit(True))
    assert {r.lang_pred for r in languages.identify(docs, none).collect()} == {"und"}
    one = languages.train(docs.filter("lang = 'de'"), F.lit(True))
    assert {(r.lang_pred, r.score) for r in languages.identify(docs.filter("doc_id < 60"), one).collect()} == {("de", 1.0)}


def test_held_out_labels_and_ids_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    a, b = (languages.train(d, ~held) for d in (docs, other))
    assert a.languages == b.languages and (a.weights == b.weights).all()
    got = Q.op13_language(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
