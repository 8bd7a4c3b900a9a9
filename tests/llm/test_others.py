"""Toxicity, pages, urls, vectors and the pipeline."""

import random
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from pyspark.core.broadcast import Broadcast
from pyspark.sql import functions as F

import corpus_pipeline
from pliego.llm import html, pivots, toxicity, url_rules
from pliego.llm import queries as Q
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
SYLLABLES = [a + b for a in "bdfklmnprst" for b in "aeiou"]


def sentence(rng, words=12):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words)) + "."


def labelled(rng, n, insults=("gronk", "blixer", "vuzzak")):
    texts, toxic = [], []
    for i in range(n):
        words = " ".join(sentence(rng) for _ in range(rng.randint(1, 5))).split()
        if i % 3 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(insults))
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    return texts, toxic


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*labelled(random.Random(1), 900), landmarks=150)


def test_held_out_texts_and_hidden_insults(model):
    score = toxicity.Scorer(model)
    texts, toxic = labelled(random.Random(2), 300)
    found = np.array(score(texts)) >= 0.7
    assert (found == np.array(toxic, bool)).mean() > 0.95
    rng = random.Random(3)
    clean = sentence(rng) + " " + sentence(rng)
    assert score([clean, "", "   "])[0] < 0.5
    for hidden in ("gro.nk", "g-ronk", "GRONK!!", "blix*er", "b l i x e r", "vuzz_ak"):
        assert score([f"{clean} {hidden} {sentence(rng)}"])[0] > score([clean])[0] + 0.2


def test_kernel_is_the_sum_over_shared_subsequences():
    kernel = toxicity.Kernel()
    rows, keys, weights = kernel.vectors(["idiot", "id.i*ot", "banana", ""])

    def product(a, b):
        one = {}
        for r, k, w in zip(rows, keys, weights):
            if r == a:
                one[k] = one.get(k, 0) + w
        return sum(one.get(k, 0) * w for r, k, w in zip(rows, keys, weights) if r == b)

    assert product(0, 0) == pytest.approx(1, abs=0.1)  # the repeated i adds a little
    assert product(0, 1) > 0.1 and product(0, 2) == 0


def test_scores_of_poor_tables(spark, model):
    rows = [(1, None), (2, ""), (1, "a"), (1, "a"), (None, "gronk"), (3, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"score": F.lit(9), "name": F.lit(1)})
    got = toxicity.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.filter("false"), model).collect() == []
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.score < 0.7 for r in got)
    assert toxicity.Scorer(toxicity.fit([], []))(["a", ""]) == pytest.approx([0.5, 0.5], abs=0.5)
    assert len(toxicity.Scorer(toxicity.fit(["a b"], [1]))(["a", ""])) == 2


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(Q.is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.training_rows(docs, labels, ~Q.is_held_out()) == toxicity.training_rows(docs, other, ~Q.is_held_out())
    got = Q.op4_toxicity(spark, SMALL).collect()
    assert len(got) == docs.count() and all((r.score >= 0.7) == bool(r.predicted) for r in got)


# pages


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="cookie-notice">ok?</div>
<article><header><h1>Head &amp; line</h1></header><p>One  <b>bold</b>
&lt;two&gt;&nbsp;x<br>y<p>Three<div class="ad">buy</div><ul><li>a</li><li>b</li></ul><form><p>mail</p></form></article>
<div id="comments"><p>first!</p></div><aside>more</aside><footer>f</footer></body></html>"""


def test_the_article_without_frames():
    got = html.main_text(html.blocks(PAGE), [], None)
    assert got == "Head & line\n\nOne bold <two> x y\n\nThree\n\na\n\nb"


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<p>a", "a<!-- b", "<script>x", "</p></p>", "<a href=\"x>y", "&#xD800;&bogus;", "<p>\x00</p>", "<article>" * 300 + "x"])
def test_broken_markup_does_not_crash(page):
    assert isinstance(html.main_text(html.blocks(page), [], None), str)


def test_pages_without_an_article_lose_the_lines_they_share(spark):
    def page(n):
        return f"<body><div>Welcome to the site</div><p>Text {n}</p><p>{'abc' * n}</p><div>All rights</div></body>"

    rows = [(n, f"https://a.example/news/{n}", page(n)) for n in range(1, 6)]
    rows += [(9, "https://b.example/x", page(9)), (10, None, page(10)), (11, "nothing", None), (12, "https://a.example/y", ""), (1, rows[0][1], page(1))]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("row", "keys", "host", "range")})
    got = {r.page_id: r.text for r in html.extract(docs).collect()}
    assert all(got[n] == f"Text {n}\n\n{'abc' * n}" for n in (2, 3, 4, 5))
    assert got[9].startswith("Welcome") and got[10].startswith("Welcome") and got[11] == "" and got[12] == ""
    assert html.extract(docs.filter("false")).collect() == []


def test_pages_with_a_small_article_keep_the_text_beside_it(spark):
    def page(n):
        return f"<body><div>Welcome</div><article><p>Read this</p></article><section><p>Text {n}</p></section><div>All rights</div></body>"

    docs = spark.createDataFrame([(n, f"https://a.example/{n}", page(n)) for n in (1, 2, 3)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html.extract(docs).collect()} == {n: f"Read this\n\nText {n}" for n in (1, 2, 3)}


BODY = "<h1>Head</h1><p>One line of the text</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<form><div>Welcome</div><article>{BODY}</article></form>", "Welcome|Head|One line of the text"),
        (f"<form><div>{BODY}</div></form><div>Rest</div>", "Head|One line of the text|Rest"),
        (f"<div class='has-sidebar no-sidebar with-banner nav-fixed'><article>{BODY}</article><div class=sidebar>Ad</div></div>", "Head|One line of the text"),
        (f"<div class=sidebar>{BODY}</div>", "Head|One line of the text"),
        (f"<div class=widget><article>{BODY}</article></div>" * 3, "|".join(["Head|One line of the text"] * 3)),
        (f"<article>{BODY}<div class='related-work'>A</div><p id='notice-of-1848'>B<p class='share-price'>C<div class='social share'>D</div></article>", "Head|One line of the text|A|B|C"),
        (f"<article>{BODY}</article><div id=comments><article>{'first ' * 30}</article></div><form>mail</form>", "Head|One line of the text"),
        (f"<div>{BODY}</div><form>mail</form><nav><article>x</article></nav>", "Head|One line of the text"),
        ("<article><p>Short</p></article><div class=ad>An advert that is longer than the page</div>", "Short"),
    ],
)
def test_wrappers_of_the_text_are_no_frame(page, want):
    assert html.main_text(html.blocks(f"<html><body>{page}</body></html>"), [], None) == want.replace("|", "\n\n")


def test_copies_are_not_compared_with_each_other(spark):
    def page(n):
        return f"<body><div>Welcome</div><p>Text {n}</p><div>All rights</div></body>"

    urls = {1: ["news/1?page=1", "news/1?page=2", "news/1", "news/1/print"], 2: ["news/2", "news/2?ref=x"], 3: ["about"]}
    rows = [(10 * n + i, f"https://a.example/{u}", page(n)) for n, us in urls.items() for i, u in enumerate(us)]
    rows += [(90 + i, f"https://b.example/x?{i}", page(9)) for i in range(3)]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract(docs).collect()}
    assert got == {i: f"Text {i // 10}" if i < 90 else "Welcome\n\nText 9\n\nAll rights" for i, _, _ in rows}


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j + 1], new[j], row[j] + (x == y)))
            row = new
        places = sorted(html.shared_lines(a, b))
        assert len(places) == row[-1]
        at = iter(b)
        assert all(any(a[i] == y for y in at) for i in places)


def test_given_pages(spark):
    import html as decode

    got = {r.page_id: r for r in Q.op1_main_text(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = r.html.split("<article>", 1)[1].split("</article>", 1)[0]
        parts = (" ".join(decode.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        want = "\n\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


# urls


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for verdict, rule in url_rules.RULES:
        at, _, under = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + under) and (not best or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


URLS = [
    "https://a.example.org/es/1", "http://Example.ORG/en/12?x=1", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://com/de/x#y",
    "http://notexample.org/es/", "http://example.org", "http://example.org?es/", "example.org/es/", "", None, "ftp://x://y.com/de/z", "http://\n.com/de/", "://org/",
]


def test_rules_and_mined_combinations(spark):
    pages = [(i, u) for i, u in enumerate(URLS)]
    pages += [(100 + i, f"http://h{i}.net/shop/{i}?ref=a") for i in range(60)] + [(200 + i, f"http://h{i}.net/news/{i}") for i in range(60)] + [(100, "http://h0.net/shop/0?ref=a")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("items", "mined", "html")})
    labels = spark.createDataFrame([(100 + i, int(i % 10 == 0)) for i in range(40)] + [(200 + i, 1) for i in range(60)] + [(None, 0), (3, None)], "doc_id bigint, quality int")
    got = {}
    for r in url_rules.judge(frame, labels).collect():
        got.setdefault(r.page_id, []).append(r)
    assert len(got[100]) == 2
    for i, url in enumerate(URLS):
        host, path, best = plain_rule(url)
        (r,) = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else "allow")
    assert all(got[100 + i][0].verdict == "block" and got[200 + i][0].verdict == "allow" for i in range(60))
    none = url_rules.judge(frame, labels.filter("false")).filter("page_id >= 100").select("verdict").distinct().collect()
    assert [r.verdict for r in none] == ["allow"]
    assert url_rules.judge(frame.filter("false"), labels).collect() == []


@pytest.mark.parametrize("lead, errors", [(0.05, 0.0), (0.05, 1.5), (0.3, 0.0)])
def test_mined_rules_equal_counting(spark, lead, errors):
    rng = random.Random(5)
    rows = [(["t" + str(rng.randint(0, 3)) + c for c in "ab"] + ["everywhere"], rng.random() < 0.3) for _ in range(300)]
    rows += [(["t9", "everywhere"], True)] * 9 + [(["t8", "everywhere"], False)] * 20
    got = url_rules.mine(spark.createDataFrame(rows + [(None, True), (["t9"], None)], "items array<string>, bad boolean"), 0.01, 0.35, lead, errors).collect()
    n, want = len(rows), {}
    for items in {c for items, _ in rows for k in (1, 2) for c in combinations(sorted(set(items) - {"everywhere"}), k)}:
        holds = [b for all_, b in rows if set(items) <= set(all_)]
        for bad in (True, False):
            k, base = sum(b == bad for b in holds), sum(b == bad for _, b in rows) / n
            confidence = k / len(holds)
            sure = confidence - base >= errors * (base * (1 - base) / len(holds)) ** 0.5
            if k >= max(8, 0.01 * n) and confidence >= 0.35 and (confidence - base) / (1 - base) >= lead and sure:
                want[items, bad] = confidence
    want = {k: c for k, c in want.items() if not any(set(i) < set(k[0]) and b == k[1] and d >= c for (i, b), d in want.items())}
    assert {(tuple(r["items"]), r.bad): pytest.approx(r.confidence) for r in got} == want
    assert (("t9",), True) in want and (("t8",), False) in want


def test_the_best_mined_rule_decides(spark):
    rows = [(i, f"http://h{i}.net/shop/x?ref=a") for i in range(40)] + [(40 + i, f"http://k{i}.net/shop/help/x") for i in range(30)] + [(70 + i, f"http://k{i}.net/home") for i in range(130)]
    labels = [(i, 0) for i in range(40)] + [(i, 1) for i in range(40, 70)] + [(i, int(i % 3 > 0)) for i in range(70, 200)]
    rows += [(300, "http://new.net/shop/help/x"), (301, "http://new.net/shop/x?ref=b"), (302, "http://new.net/home"), (303, None), (304, "http://example.org/es/shop/help")]
    found = url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    got = {r.page_id: r for r in found.collect()}
    assert got[300].mined_verdict == got[300].verdict == "allow" and got[300].mined == "path=help" and got[300].mined_confidence == 1
    assert got[301].mined_verdict == got[301].verdict == "block" and got[301].mined_confidence == 1
    assert (got[302].mined, got[302].mined_verdict, got[302].verdict) == (None, None, "allow")
    assert (got[303].mined, got[303].verdict) == (None, "allow")
    assert (got[304].mined_verdict, got[304].rule, got[304].verdict) == ("allow", "example.org/es/", "block")


# vectors


def test_pivot_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "QUERIES", 3)
    monkeypatch.setattr(pivots, "CANDIDATES", 16)
    monkeypatch.setattr(pivots, "FIRST", 4)
    monkeypatch.setattr(pivots, "BATCH", 4)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 5))
    vectors = {i: (centres[i % 4] + 0.2 * rng.normal(size=5)).tolist() for i in range(150)}
    vectors |= {200 + i: vectors[0] for i in range(30)}  # ties
    odd = [(401, None), (402, [1.0, None, 0.0, 0.0, 0.0]), (403, [float("nan")] * 5), (404, [float("inf")] * 5), (None, [1.0] * 5)]
    frame = spark.createDataFrame([*vectors.items(), *odd], "vec_id bigint, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit(2)})
    got = {tuple(r) for r in pivots.top_k(frame, F.col("vec_id") % 20 == 0, 7).collect()}
    assert got == brute.top_k(vectors, 7)
    few = frame.filter("vec_id in (0, 1, 2)")
    assert pivots.top_k(few, F.col("vec_id") % 20 == 0).count() == 2
    assert pivots.top_k(frame.filter("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_pivot_batches_are_written_and_released(spark, monkeypatch):
    released, destroy = [], Broadcast.destroy
    monkeypatch.setattr(pivots, "BATCH", 4)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: (released.append(self), destroy(self, blocking))[1])
    vectors = {i: [float(i % 7), float(i % 11)] for i in range(200)}
    frame = spark.createDataFrame([*vectors.items()], "vec_id bigint, embedding array<double>")
    found = pivots.top_k(frame, F.col("vec_id") % 20 == 0, 7)
    assert len(released) == 3 and {tuple(r) for r in found.collect()} == brute.top_k(vectors, 7)


def test_bounds_are_never_too_small():
    rng = np.random.default_rng(7)
    x = rng.integers(-64, 64, (300, 8))
    p = pivots.choose_pivots(x, 5)
    bound = pivots.bounds(x, pivots.distances(x, p), x, pivots.distances(x, p))
    assert (bound >= x @ x.T).all()
    near = np.concatenate([10 * rng.integers(-64, 64, (6, 1, 8)) + rng.integers(-1, 2, (6, 30, 8))]).reshape(-1, 8)
    far = np.concatenate([near, [[64 * 100_000] + [0] * 7]])  # the pivot farthest away makes distances large
    p = pivots.choose_pivots(far, 5)
    assert far[-1].tolist() in p.tolist()
    bound = pivots.bounds(far, pivots.distances(far, p), far, pivots.distances(far, p))
    assert (bound >= far @ far.T).all() and (bound.diagonal()[:-1] < (near**2).sum(1) + 64).all()
    big = np.array([[2**31, 1], [-(2**31), 3]])
    assert (pivots._products(big, big) == big @ big.T).all()


# the pipeline


def test_stages_are_in_order_and_each_does_its_part(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SMALL)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == {d for d, (_, _, kept) in brute.near({d: r.text for d, r in before.items()}).items() if kept}
        if name == "decontamination":
            low = lambda t: " ".join(t.lower().split())
            items = [low(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert not any(i in low(r.text) for i in items for r in after.values())
        if name == "secrets":
            assert set(after) == set(before)
            assert all(brute.base_secrets(r.text)[:3] == (0, 0, 0) for r in after.values())
            assert all(after[d].text == r.text for d, r in before.items() if brute.base_secrets(r.text)[:3] == (0, 0, 0))
        docs = spark.createDataFrame(list(after.values()), docs.schema)


def test_run_packs_what_the_stages_keep(spark):
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.count() > 0
    assert Q.QUERIES["pipeline"] is Q.pipeline


def test_landmark_features_in_parts_give_the_same_model(monkeypatch):
    rows = labelled(random.Random(2), 200)
    whole = toxicity.Scorer(toxicity.fit(*rows, landmarks=40))(rows[0][:50])
    monkeypatch.setattr(toxicity, "FEATURES", 37)
    parts = toxicity.Scorer(toxicity.fit(*rows, landmarks=40))(rows[0][:50])
    assert parts == pytest.approx(whole, abs=1e-6)


def test_fit_holds_one_large_array_at_a_time():
    """The driver fits the model: the machine's rows, the words' table and the text scorer's must not add up."""
    rows = labelled(random.Random(6), 1500)
    tracemalloc.start()
    try:
        toxicity.fit(*rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70 << 20  # the table of words has 32 MB
