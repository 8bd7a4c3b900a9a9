import datetime

import pytest
from pyspark.sql import functions as F

from pliego.session import shared_folder
from pliego.streaming import jobs, state_table


def write(spark, rows, schema, folder, name):
    """One more input file, as a feed would drop it."""
    path = shared_folder(spark, "drop")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


CHAT = "conv_id bigint, turn bigint, role string, text string"


def test_chat_state_goes_on_where_it_stopped_and_spans_blocks(spark):
    folder, out = shared_folder(spark, "in"), shared_folder(spark, "state")
    long = jobs.TURN_BLOCK + 2
    roles = ["user", "assistant"]
    write(spark, [(1, t, roles[t % 2], f"m{t}") for t in range(long)] + [(2, 0, "system", "s"), (2, 1, "user", "a")], CHAT, folder, "a")
    first = {r.conv_id: r for r in jobs.chat_state(stream(spark, folder, CHAT), out).collect()}
    assert first[1].messages == long and first[2].messages == 1
    assert first[1].history_tail == "\n".join(
        ("User: " if t % 2 == 0 else "AI: ") + f"m{t}" for t in range(long - 4, long)
    )
    write(spark, [(2, 2, "assistant", "b"), (3, 0, "user", "c")], CHAT, folder, "b")
    again = {r.conv_id: r for r in jobs.chat_state(stream(spark, folder, CHAT), out).collect()}
    assert {c: r.messages for c, r in again.items()} == {1: long, 2: 2, 3: 1}
    assert again[2].history_tail == "User: a\nAI: b"


def test_chat_state_comes_back_after_silence(spark, monkeypatch):
    import time

    monkeypatch.setattr(jobs, "SILENCE_MS", 1000)
    folder, out = shared_folder(spark, "in"), shared_folder(spark, "state")
    for name, rows in (("a", [(1, 0, "user", "a"), (1, 1, "assistant", "b")]), ("b", [(2, 0, "user", "x")]), ("c", [(1, 2, "user", "c")])):
        write(spark, rows, CHAT, folder, name)
        got = {r.conv_id: r for r in jobs.chat_state(stream(spark, folder, CHAT), out).collect()}
        time.sleep(1.5)
    assert got[1].messages == 3 and got[1].history_tail == "User: a\nAI: b\nUser: c"


def test_the_state_table_has_one_row_per_state_after_many_batches(spark):
    path, want = shared_folder(spark, "states"), {}
    for n in range(5):
        rows = [(c, 0, 0, 10 * n + c, f"t{n}") for c in range(n, n + 4)]
        want |= {r[:3]: r for r in rows}
        state_table.merge(spark.createDataFrame(rows, state_table.STATE), n, path)
    got = [tuple(r) for r in state_table.load(spark, path).collect()]
    assert len(got) == len(want) and set(got) == set(want.values())
    files = spark.read.parquet(f"{path}/side-0").count() + spark.read.parquet(f"{path}/side-1").count()
    assert files <= 2 * len(want)  # rows on disk, both sides, do not grow with the batches
    assert len(state_table.manifest(spark, path)) <= min(len(want), state_table.BUCKETS)


def test_a_replayed_or_failed_batch_changes_nothing(spark, monkeypatch):
    path = shared_folder(spark, "states")
    batch = lambda *rows: spark.createDataFrame(list(rows), state_table.STATE)
    state_table.merge(batch((1, 0, 0, 1, "a"), (2, 0, 0, 1, "x")), 0, path)
    state_table.merge(batch((1, 0, 0, 2, "b")), 1, path)
    want = {(1, 0, 0, 2, "b"), (2, 0, 0, 1, "x")}
    state_table.merge(batch((1, 0, 0, 9, "again")), 1, path)
    assert {tuple(r) for r in state_table.load(spark, path).collect()} == want
    fails = F.raise_error(F.lit("lost")).cast("string")
    with pytest.raises(Exception, match="lost"):
        state_table.merge(batch((1, 0, 0, 3, "c"), (2, 0, 0, 2, "y")).withColumn("tail", F.when(F.col("conv_id") == 2, fails).otherwise(F.col("tail"))), 2, path)
    assert {tuple(r) for r in state_table.load(spark, path).collect()} == want
    state_table.merge(batch((1, 0, 0, 3, "c"), (2, 0, 0, 2, "y")), 2, path)
    assert {tuple(r) for r in state_table.load(spark, path).collect()} == {(1, 0, 0, 3, "c"), (2, 0, 0, 2, "y")}


def test_ingest_keeps_given_page_numbers(spark):
    schema = "source string, doc_id bigint, lang string, page bigint, page_content string"
    folder, out = shared_folder(spark, "in"), shared_folder(spark, "store")
    write(spark, [("./a.pdf", 1, "es", 7, "corto"), ("./a.pdf", 2, "es", None, "corto")], schema, folder, "a")
    got = jobs.ingest(stream(spark, folder, schema), out, "now")
    assert {(r.doc_id, r.page) for r in got.collect()} == {(1, 7), (2, 0)}


def test_ingest_appends_only_new_pages(spark):
    schema = "source string, doc_id bigint, lang string, page_content string"
    folder, out = shared_folder(spark, "in"), shared_folder(spark, "store")
    write(spark, [("./a.pdf", 1, "es", "x" * 1500)], schema, folder, "a")
    assert jobs.ingest(stream(spark, folder, schema), out, "now").count() == 2
    write(spark, [(None, 2, "es", "corto")], schema, folder, "b")
    got = jobs.ingest(stream(spark, folder, schema), out, "now")
    assert {(r.doc_id, r.chunk_index, r.source, r.file_name, r.page) for r in got.collect()} == {
        (1, 0, "./a.pdf", "a.pdf", 0), (1, 1, "./a.pdf", "a.pdf", 0), (2, 0, "desconocido", "desconocido", 0)
    }


def test_late_events_are_dropped_and_open_sessions_wait(spark):
    schema = "user_id bigint, ts timestamp_ntz"
    folder, out = shared_folder(spark, "in"), shared_folder(spark, "sessions")
    t0, hour = datetime.datetime(2024, 1, 1), datetime.timedelta(hours=1)
    write(spark, [(1, t0), (1, t0 + 3 * hour), (2, t0 + 100 * hour)], schema, folder, "a")
    got = jobs.expired_sessions(stream(spark, folder, schema), out).collect()
    assert [(r.user_id, r.n_events, r.expires_ts) for r in got] == [(1, 2, t0 + 27 * hour)]
    write(spark, [(1, t0 + 4 * hour), (3, t0 + 200 * hour)], schema, folder, "b")
    got = jobs.expired_sessions(stream(spark, folder, schema), out).collect()
    assert sorted((r.user_id, r.n_events) for r in got) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("name, table", [("stream_ingest", "documents"), ("stream_chat_state", "conversations")])
def test_tables_may_be_folders_of_files(spark, name, table):
    from pliego.plans import registry

    small, folder = "/root/testdata/sf0.001", shared_folder(spark, "parts")
    spark.read.parquet(f"{small}/{table}.parquet").repartition(3).write.parquet(f"{folder}/{table}.parquet")
    whole, parts = (registry.QUERIES[name](spark, path) for path in (small, folder))
    assert whole.count() > 0
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0
