import pytest
from pyspark.sql import functions as F

from pliego.operators import metadata, summaries
from pliego.plans import ingest, retrieval
from pliego.session import shared_folder
from pliego.sources import store, tables

PAGES = "source string, doc_id bigint, page_content string"


def placed(spark, rows):
    return metadata.place_pages(spark.createDataFrame(rows, PAGES))


def joined_text(rows, source):
    """The file's chunks in order, joined by line ends, in plain Python."""
    parts = []
    for _, _, text in sorted(r for r in rows if r[0] == source):
        at = 0
        while True:
            parts.append(text[at : at + 1000])
            if at + 1000 >= len(text):
                break
            at += 800
    return parts, "\n".join(parts)


ROWS = [("a", 9, "x" * 1900), ("a", 3, "y" * 10), ("b", 4, "z" * 700), ("a", 12, ""), ("c", 1, "s" * 299), ("d", 2, "q" * 500), ("e", 7, "r" * 501)]


def test_pages_and_chunks_are_placed_in_their_file(spark):
    chunks = metadata.chunk_placed(placed(spark, ROWS)).collect()
    for source in "abcde":
        parts, text = joined_text(ROWS, source)
        mine = sorted((r for r in chunks if r.source == source), key=lambda r: r.chunk_index)
        assert [r.page_content for r in mine] == parts
        assert [r.chunk_index for r in mine] == list(range(len(parts)))
        assert all(text[r.char_start : r.char_start + len(r.page_content)] == r.page_content for r in mine)
        assert {(r.total_chars, r.total_chunks) for r in mine} == {(len(text), len(parts))}


def test_pieces_give_the_whole_text(spark):
    pieces = summaries.text_pieces(placed(spark, ROWS)).collect()
    for source in "abcde":
        mine = sorted((r for r in pieces if r.source == source), key=lambda r: r.chunk_index)
        assert "".join(r.piece for r in mine) == joined_text(ROWS, source)[1]


def test_simple_summaries(spark):
    got = {r.source: r.document_summary for r in summaries.simple_summaries(placed(spark, ROWS)).collect()}
    for source in "abcde":
        text = joined_text(ROWS, source)[1]
        assert got[source] == (text[:500] + "..." if len(text) > 500 else text)


def test_guards(spark):
    sizes = [299, 300, 500, 501, 5001]
    df = spark.createDataFrame([("t" * n,) for n in sizes], "t string")
    text = F.col("t")
    got = df.select(F.length(summaries.model_input(text)), summaries.guarded(text, summaries.model_input(text))).collect()
    assert [r[0] for r in got] == [299, 300, 500, 501, 5000]
    assert [r[1] for r in got] == ["t" * 299, "t" * 300, "t" * 500] + ["t" * 497 + "..."] * 2


def test_extractive_summary_takes_frequent_sentences_in_text_order(spark):
    words = " ".join(a + b for a in "bcdfghjklm" for b in ("ana", "ene", "ini", "ono", "unu", "aba", "eme", "iri"))
    text = f"{words}.\nla casa la casa.{words[::-1]}\ncasa la casa"
    got = summaries.extractive_summaries(placed(spark, [("a", 1, text), ("b", 2, "w" * 600), ("c", 3, "corto. texto")]))
    got = {r.source: r.document_summary for r in got.collect()}
    assert got["a"] == f"{words}. la casa la casa. casa la casa"
    assert got["b"] == "w" * 497 + "..." and got["c"] == "corto. texto"


def test_summaries_reach_every_chunk_of_a_large_file(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, F.lit("hot")).otherwise(F.lit("none")).alias("source"),
                                    F.col("id").cast("int").alias("chunk_index"))
    told = spark.createDataFrame([("hot", "s", 900)], "source string, document_summary string, total bigint")
    got = summaries.attach_summaries(rows, told, "chunk_index", "total", block=64)
    assert sorted((r.source, r.document_summary, r["count"]) for r in got.groupBy("source", "document_summary").count().collect()) == [
        ("hot", "s", 900), ("none", "", 100)
    ]


def test_chunks_without_an_index_count_as_first(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "i int")
    got = [r[0] for r in df.select(summaries.prefix_first(F.lit("c"), F.lit("s"), F.col("i"))).collect()]
    first = "[RESUMEN DEL DOCUMENTO]\ns\n\n[FRAGMENTO 1]\nc"
    assert got == [first, "c", first]


def test_types_are_compared_without_a_dot(spark):
    df = spark.createDataFrame([("a.PDF",), ("xpdf",), ("a.txt",)], "path string")
    assert [r.path for r in metadata.filter_by_type(df, "path", "Pdf").collect()] == ["a.PDF", "xpdf"]


def test_a_new_store_replaces_the_old_one(spark):
    made = ingest.chunk_store(spark, "/root/testdata/sf0.001")
    path = shared_folder(spark, "store")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    store.save(made, path)
    store.save(made.filter("chunk_index = 0"), path)
    again = store.load(spark, path)
    assert again.count() == made.select("source").distinct().count()
    assert again.filter("size(embedding) <> 64").count() == 0


def test_an_empty_ingest_leaves_the_old_store(spark):
    made = ingest.chunk_store(spark, "/root/testdata/sf0.001")
    path = shared_folder(spark, "store")
    assert store.save(made.limit(5), path)
    assert not store.save(made.filter("false"), path)
    assert store.load(spark, path).count() == 5


def test_other_sizes_go_through_the_whole_job(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    made = ingest.chunks_of(pages, summary=summaries.simple_summaries, size=300, overlap=50).collect()
    for source in "abcde":
        mine = sorted((r for r in made if r.source == source), key=lambda r: r.chunk_index)
        want = []
        for _, _, text in sorted(r for r in ROWS if r[0] == source):
            at = 0
            while True:
                want.append(text[at : at + 300])
                if at + 300 >= len(text):
                    break
                at += 250
        assert [r.page_content.split("[FRAGMENTO 1]\n")[-1] for r in mine] == want
        joined = "\n".join(want)
        assert mine[0].document_summary == (joined[:500] + "..." if len(joined) > 500 else joined)
    assert sorted(r.chunk_id for r in made) == list(range(len(made)))


def test_ids_of_any_size(spark):
    rows = [("a", 2**62, "x" * 1900), ("a", -(2**62), "y"), ("b", 2**63 - 1, "z")]
    got = sorted((r.chunk_id, r.doc_id, r.page, r.chunk_index) for r in metadata.chunk_placed(placed(spark, rows)).collect())
    assert got == [(0, -(2**62), 0, 0), (1, 2**62, 1, 1), (2, 2**62, 1, 2), (3, 2**62, 1, 3), (4, 2**63 - 1, 0, 0)][:len(got)] and len(got) == 5


def test_small_scans_are_spread(spark):
    pages = tables.pages(spark, "/root/testdata/sf0.001")
    assert pages.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_save_that_fails_halfway_leaves_the_old_store(spark):
    made = ingest.chunk_store(spark, "/root/testdata/sf0.001").limit(40).persist()
    path = shared_folder(spark, "store")
    assert store.save(made, path)
    broken = made.withColumn("source", F.when(F.col("chunk_id") == made.agg(F.max("chunk_id")).first()[0], F.raise_error(F.lit("halfway"))).otherwise(F.col("source")))
    with pytest.raises(Exception, match="halfway"):
        store.save(broken, path)
    assert store.load(spark, path).count() == 40
    assert store.manifest(spark, path).version == 1


def test_a_save_runs_the_plan_once(spark):
    ran = spark.sparkContext.accumulator(0)
    made = ingest.chunk_store(spark, "/root/testdata/sf0.001").limit(30)

    def seen(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    path = shared_folder(spark, "store")
    assert store.save(made.repartition(3).mapInArrow(seen, made.schema), path)
    assert ran.value == 30 == store.manifest(spark, path).rows


def test_snapshots_stay_until_they_are_dropped(spark):
    made = ingest.chunk_store(spark, "/root/testdata/sf0.001").limit(9).persist()
    path = shared_folder(spark, "store")
    assert store.load(spark, path).count() == 0 and store.manifest(spark, path) is None and store.drop_old(spark, path) == []
    assert store.save(made, path)
    before = store.load(spark, path)
    assert store.save(made.limit(4), path)
    assert before.count() == 9 and store.load(spark, path).count() == 4
    assert len(store.drop_old(spark, path)) == 1
    assert store.load(spark, path).count() == 4 and before.sparkSession.read.schema(store.STORE_SCHEMA).parquet(before.inputFiles()[0].rsplit("/", 1)[0]).count() == 0


def test_text_of_other_pages_stays_where_few_pages_are_heads(spark):
    pages = spark.createDataFrame([(f"f{i % 3}", i, "word " * (400 + i)) for i in range(90)], "source string, doc_id bigint, page_content string")
    places = metadata.place(metadata.page_sizes(pages))
    heads = metadata.head_pages(places, pages, 5000)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = {r.doc_id for r in places.collect() if r.char_start <= 5000}
    assert {r.doc_id for r in heads.collect()} == want and len(want) < 12


def test_chunks_that_were_found_are_read_without_a_shuffle(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 65537, 10**6]
    chunks = spark.createDataFrame([(i + d, f"text {i + d}") for i in ids for d in (0, 3)], "chunk_id bigint, page_content string").distinct()
    path = shared_folder(spark, "holding")
    chunks.write.parquet(path)
    found = spark.createDataFrame([(q, i) for i in ids for q in (1, 2)], "query_id bigint, chunk_id bigint")
    got = store.holding(spark.read.parquet(path), found)
    assert got.columns == ["chunk_id", "page_content"]
    assert sorted(r.chunk_id for r in got.collect()) == ids
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Exchange hashpartitioning" not in plan
    assert store.holding(spark.read.parquet(path), found.filter("false")).count() == 0


def test_an_index_writes_ids_and_vectors_only(spark):
    import pyarrow.parquet as pq

    files = retrieval.index(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all(pq.read_schema(f.removeprefix("file://")).names == ["chunk_id", "embedding"] for f in files)
