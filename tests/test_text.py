import pytest
from pyspark.sql import functions as F

from pliego.functions import text as X


def column(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_citations(spark):
    rows = [("historia_de_la_universidad.pdf", "42"), ("REGLAMENTO docente.txt", None), ("a__b.pdf.pdf", "None"), (None, "3"), ("", None)]
    assert column(spark, X.citation(F.col("file_name"), F.col("page")), rows, "file_name string, page string") == [
        "Historia De La Universidad (página 42)",
        "Reglamento docente",
        "A  B",
        "Documento desconocido (página 3)",
        "Documento desconocido",
    ]


def test_annotations_print_a_missing_name(spark):
    rows = [("a.pdf", 3), ("a.pdf", None), (None, 0)]
    assert column(spark, X.source_annotation(F.col("n"), F.col("p")), rows, "n string, p int") == [
        "[Fuente: a.pdf, página 3]", "[Fuente: a.pdf]", "[Fuente: None, página 0]"
    ]


def test_file_names(spark):
    long = "./data/" + "x" * 51
    rows = [("./data/tesis.pdf",), ("tesis.pdf",), ("",), (None,), (long,), ("./data/" + "y" * 50,), ("a/",)]
    assert column(spark, X.file_name(F.col("s")), rows, "s string") == [
        "tesis.pdf", "tesis.pdf", "Documento sin nombre", "Documento sin nombre", "x" * 47 + "...", "y" * 50, ""
    ]


@pytest.mark.parametrize("text", ["\n\n a b \t", "　x ", "   ", "", "a\nb\n", "\x1cq\x1f"])
def test_strip_agrees_with_python(spark, text):
    assert column(spark, X.strip(F.col("t")), [(text,)], "t string") == [text.strip()]
    assert column(spark, X.one_line(F.col("t")), [(text,)], "t string") == [text.replace("\n", " ").strip()]


def test_vectors_have_length_one_and_share_buckets(spark):
    from pliego.functions.vectors import embed

    rows = [("Árbol árbol, casa!",), ("casa ÁRBOL árbol",), ("123 --",), (None,)]
    a, b, empty, null = column(spark, embed(F.col("t")), rows, "t string")
    assert a == b and len(a) == 64 and abs(sum(x * x for x in a) - 1) < 1e-6
    assert sorted(set(a))[1:] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert empty == null == [0.0] * 64


def test_few_texts_are_tokenised_at_once(monkeypatch):
    import pyarrow as pa

    from pliego.functions import vectors

    seen, plain = [], vectors.counted
    monkeypatch.setattr(vectors, "counted", lambda content: seen.append(len(content)) or plain(content))
    texts = [f"uno dos {'tres ' * (n % 5)}" if n % 7 else None for n in range(1000)]
    got = vectors._embed.func(pa.array(texts))
    assert max(seen) <= 256 and sum(seen) == len(got) == 1000
    assert got.to_pylist()[2] == vectors._embed.func(pa.array(texts[2:3])).to_pylist()[0]
    assert len(vectors._embed.func(pa.array([], pa.string()))) == 0


def test_tokens_are_found_and_hashed_by_arrays():
    """Against one regular expression and one md5 per token, with letters of one to four bytes and tokens of all lengths."""
    import hashlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from pliego import constants as K
    from pliego.functions import vectors

    some = ["", None, "Árbol árbol, casa!", "x1y_z", "İİ ǅ 中文 𝒜😀 ẞß́a", "\x00a\nb", "é", "é", *("ñ" * n + "a " + "b" * n for n in range(130))]
    texts = pa.array(some, pa.string())
    for part in (texts, texts.slice(3), texts.slice(0, 2), texts.slice(0, 0)):
        expected = np.zeros((len(part), K.VECTOR_BUCKETS), int)
        for row, tokens in enumerate(pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(part, "")), pattern=K.TOKEN_BREAK).to_pylist()):
            for token in filter(None, tokens):
                expected[row, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % K.VECTOR_BUCKETS] += 1
        assert (vectors.counted(part) == expected).all()
    text = np.frombuffer(b"abc" * 500, np.uint8)
    ends = np.cumsum(np.r_[0, np.arange(50)])
    assert vectors.buckets(ends, text).tolist() == [vectors.bucket(text[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
