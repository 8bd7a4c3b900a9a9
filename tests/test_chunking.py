import random

import pytest
from pyspark.sql import functions as F

from pliego.operators import chunking

PAGES = "doc_id bigint, page_content string"


def chunks(spark, text, **how):
    df = spark.createDataFrame([(0, text)], PAGES)
    return [r.page_content for r in chunking.chunk_fixed(df, **how).orderBy("pos").collect()]


@pytest.mark.parametrize("size", [0, 1000, 1001, 1800, 1801, 2500])
def test_fixed_windows(spark, size):
    text = "".join(chr(97 + i % 26) for i in range(size))
    got = chunks(spark, text)
    starts = [0]
    while starts[-1] + 1000 < size:
        starts.append(starts[-1] + 800)
    assert got == [text[s : s + 1000] for s in starts]


def test_sweep_counts_what_splitting_gives(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([0, 5, 10, 11, 99, 100])], PAGES)
    for r in chunking.sweep(df, [(10, 0), (10, 3), (40, 39)]).collect():
        cut = chunking.chunk_fixed(df, r.chunk_size, r.chunk_overlap)
        assert (r.chunks, r.chars) == cut.agg(F.count("*"), F.sum(F.length("page_content"))).first()


def recursive(spark, text, size, overlap):
    df = spark.createDataFrame([(0, text)], PAGES)
    return [(r.start, r.page_content) for r in chunking.chunk_recursive(df, size, overlap).orderBy("pos").collect()]


def test_recursive_prefers_paragraphs_then_lines_then_words(spark):
    text = "aaaa bbbb\n\ncccc dddd eeee\nffff"
    assert [c for _, c in recursive(spark, text, 15, 0)] == ["aaaa bbbb", "cccc dddd eeee", "ffff"]
    assert [c for _, c in recursive(spark, "w" * 25, 10, 2)] == ["w" * 10, "w" * 10, "w" * 9]


def test_recursive_keeps_the_longest_tail_that_fits(spark):
    assert [c for _, c in recursive(spark, "aa bb cc dd ee", 9, 6)] == ["aa bb cc", "bb cc dd", "cc dd ee"]
    assert [c for _, c in recursive(spark, "aa bb cc dd ee", 8, 6)] == ["aa bb cc", "cc dd", "dd ee"]


def test_recursive_promises_hold_on_random_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab  \n\n\té") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), PAGES)
    for size, overlap in ((10, 0), (10, 4), (50, 20), (4, 3)):
        assert chunking.invariant_violations(df, size, overlap).first() == (0, 0, 0, 0, 0, 0)


def test_the_splitter_equals_its_recursive_twin_on_random_texts(spark):
    import duckdb

    from pliego.plans.oracle.ingest import recursive_chunks

    rng = random.Random(11)
    texts = ["".join(rng.choice("ab  \n\n\té") for _ in range(rng.randint(0, 400))) for _ in range(80)]
    texts += ["", " \n ", "w" * 130, "a b" * 60, "\n\n\n".join("xy z" * rng.randint(0, 30) for _ in range(9))]
    df = spark.createDataFrame(list(enumerate(texts)), PAGES)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, 's', 'l')", list(enumerate(texts)))
    for size, overlap in ((10, 0), (10, 4), (50, 20), (7, 6)):
        got = {tuple(r) for r in chunking.chunk_recursive(df, size, overlap).select("doc_id", "pos", "start", "page_content").collect()}
        assert got == set(con.execute(recursive_chunks(size, overlap)).fetchall())


def test_no_chunk_contains_its_neighbour(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab  \n\n\té") for _ in range(300)) for _ in range(40)]
    for text in texts:
        for size, overlap in ((10, 4), (30, 29)):
            spans = [(start, start + len(part)) for start, part in chunking._pack(text, size, overlap)]
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize(
    "text, size, overlap, chunks, want",
    [
        ("abcdef", 1, 0, [(0, "zz"), (0, "ab")], (2, 1, 1, 1, 1, 0)),
        ("aaaaa", 4, 0, [(0, "aaaaa")], (1, 0, 0, 0, 0, 0)),
        ("aa bb", 4, 0, [(0, "ax"), (3, "bb")], (0, 1, 0, 0, 0, 0)),
        ("aa bb cc", 4, 0, [(0, "aa"), (6, "cc")], (0, 0, 1, 0, 0, 0)),
        ("aaaa bb", 4, 1, [(0, "aaaa"), (1, "aaa"), (5, "bb")], (0, 0, 0, 1, 0, 0)),
        ("aaaaaa", 4, 3, [(2, "aaaa"), (0, "aaaa")], (0, 0, 2, 1, 1, 0)),
        ("aa bb cc", 8, 0, [(0, "aa"), (3, "bb cc")], (0, 0, 0, 0, 0, 1)),
        ("aa bb\n\ncc dd ee", 9, 0, [(0, "aa bb"), (7, "cc dd ee")], (0, 0, 0, 0, 0, 0)),
        ("a\n\nbbbb cc", 9, 0, [(0, "a"), (3, "bbbb"), (8, "cc")], (0, 0, 0, 0, 0, 1)),
    ],
)
def test_broken_promises_are_counted(spark, monkeypatch, text, size, overlap, chunks, want):
    monkeypatch.setattr(chunking, "_pack", lambda *_: iter(chunks))
    df = spark.createDataFrame([(0, text)], PAGES)
    assert tuple(chunking.invariant_violations(df, size, overlap).first()) == want


def test_overlap_must_be_smaller_than_the_chunk(spark):
    with pytest.raises(ValueError):
        chunking.split_recursive(spark.createDataFrame([(0, "a")], PAGES), 10, 10)
