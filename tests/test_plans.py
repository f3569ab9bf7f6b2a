"""Shapes of the physical plans."""

import re

import pytest

from weir.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
WRITES = {"dual_sink", "inbox_recent", "archive_index", "stream_inbox", "stream_inbox_wm", "stream_source_counts", "read_inbox", "stream_read", "inbox_files", "archive_run"}
NO_SHUFFLE = ["harvest_links", "link_lines", "unified_all", "page_main_text", "convert_generic", "srt_transcript", "audio_plan",
              "url_guard", "quality_gates", "bilibili_payload", "url_candidates"]
LIMITED = ["page_inbox", "merge_links", "tweet_fallback", "wechat_fallback", "xhs_fallback", "telegram_recent",
           "telegram_latest", "subtitle_pick", "srt_distinct_lines"]


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cross_join_and_no_python_worker(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "FlatMapCoGroups"):
        assert bad not in text


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_row_local_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", LIMITED)
def test_ranked_queries_limit_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert len(re.findall(r"WindowGroupLimit .*Partial", text)) >= 1


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<doc_id:bigint,source:string>" not in plan(spark, "source_counts")
    assert "ReadSchema: struct<source:string>" in plan(spark, "source_counts")


def test_stored_queries_read_partitions(spark):
    assert "PartitionFilters: [isnotnull(source_type" in plan(spark, "inbox_by_source")
    assert re.search(r"PartitionFilters: \[isnotnull\(day", plan(spark, "inbox_clear_old"))
    text = plan(spark, "inbox_append")
    assert re.search(r"PartitionFilters: \[prefix#\w+ IN(SET)? .*ReadSchema: struct<id:string", text)
    # The content meets the accepted rows only: nothing is ranked or shuffled with it before.
    assert not re.search(r"(Window|Sort) .*content", text)


def test_reading_is_row_local(spark):
    from weir.operators import reading

    asked = spark.createDataFrame([], reading.REQUEST_DDL)
    text = reading.read(asked, "2024-01-31T00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Window" not in text and "Union" not in text
