"""Every registered query beside its DuckDB twin on the smallest tables, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as entry_module
from pliego.plans import registry
from tests.compare import arrow, connect, differences

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_twin(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    got = frame.toArrow()
    assert got.num_rows > 0
    plan = frame._jdf.queryExecution().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    if name in SQL:
        assert differences(got, arrow(duck.execute(SQL[name]))) == ""


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.SQL)


@pytest.mark.parametrize(
    "name",
    ["ingest_counts", "chunk_index", "default_source", "file_name", "processed_date", "default_page", "extract_source_info", "format_citation", "source_annotation"],
)
def test_no_text_is_shuffled_for_its_length(spark, name):
    plan = executed(registry.QUERIES[name](spark, SMALL))
    for line in plan.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert "page_content" not in line and "text#" not in line


def test_entry_gives_one_context_per_query(spark):
    got = entry_module.entry(spark)
    assert got.columns == ["query_id", "context", "fragments"]
    assert got.count() == got.select("query_id").distinct().count()


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = executed(QUERIES["session_expiry"](spark, SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan
    plan = executed(QUERIES["parse_response_sources"](spark, SMALL))
    assert "EqualTo(role,assistant)" in plan


def test_newest_messages_are_cut_before_the_shuffle(spark):
    assert executed(QUERIES["history_limit_n"](spark, SMALL)).count("WindowGroupLimit") >= 2


def test_chunking_does_not_shuffle_text_of_large_scans(spark):
    from pliego.operators.chunking import chunk_fixed, chunk_recursive
    from pliego.sources import tables

    pages = tables.as_pages(tables.read(spark, SMALL, "documents"))
    assert "Exchange" not in executed(chunk_fixed(pages)) + executed(chunk_recursive(pages))
