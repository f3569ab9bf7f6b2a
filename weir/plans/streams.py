"""Queries run as Structured Streaming jobs over the landed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.model import record_columns
from weir.plans.landed import AS_OF, view
from weir.plans.records import inbox_records
from weir.plans.registry import query
from weir.session import fresh_path
from weir.sinks.store import InboxStore
from weir.streaming import ingest

DOCUMENTS_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _stream(spark, sf):
    """The documents files as a stream of records, shaped like the batch inbox input."""
    # The pattern fits a single file as well as a folder of that name.
    docs = spark.readStream.schema(DOCUMENTS_DDL).parquet(f"{sf}/documents.parquet*")
    kinds = F.array(*(F.lit(k) for k in ["telegram", "rss", "bilibili", "xhs", "twitter", "wechat", "youtube", "manual"]))
    doc = F.col("doc_id")
    fields = dict(
        url=F.when(doc % 50 == 0, "").otherwise(F.concat(F.lit("https://d.example.org/"), F.md5("text"))),
        source_type=F.get(kinds, doc % 8), source_name=F.col("source"), title=F.left("text", F.lit(100)), content=F.col("text"),
        fetched_at=F.concat(
            F.lit("2024-01-"), F.lpad((1 + doc % 28).cast("string"), 2, "0"),
            F.when(doc % 2 == 0, "T00:00:00").otherwise("T00:00:00.000001"),
        ),
    )
    return docs.select(doc.alias("seq"), *record_columns(AS_OF, **fields))


@query("stream_inbox", "select seq, id, source_type, title from v_store")
def stream_inbox(spark, sf):
    root = fresh_path(spark, "stream")
    store = InboxStore(spark, f"{root}/store")
    ingest.run_inbox(_stream(spark, sf), store, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return store.load().select("seq", "id", "source_type", "title")


@query("stream_inbox_wm", "select distinct id from v_records")
def stream_inbox_wm(spark, sf):
    """Bounded de-duplication over files that land with the latest days first: kept and late ids together are all ids.

    Each drop lands as many files as its tasks write and is drained as one micro-batch before the next one lands.
    """
    root = fresh_path(spark, "stream")
    rows = inbox_records(view(spark, sf, "v_inbox")).select("id", F.to_timestamp(F.concat("fetched_at", F.lit("Z"))).alias("at"))
    for first, last in ((19, 28), (10, 18), (1, 9)):
        rows.filter(F.dayofmonth("at").between(first, last)).write.mode("append").parquet(f"{root}/landed")
        timed = spark.readStream.schema("id string, at timestamp").parquet(f"{root}/landed")
        ingest.run_dedup(timed, f"{root}/out", f"{root}/checkpoint", delay="3 days").awaitTermination()
    kept, late = ingest.read_dedup(spark, f"{root}/out", "id string, at timestamp")
    return kept.unionByName(late)


@query("stream_source_counts", "select substr(fetched_at, 1, 10) as day, source_type, count(*) as n from v_records group by 1, 2")
def stream_source_counts(spark, sf):
    root = fresh_path(spark, "stream")
    timed = _stream(spark, sf).select("source_type", F.to_timestamp(F.concat("fetched_at", F.lit("Z"))).alias("at"))
    ingest.count_days(timed, "at", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return ingest.read_days(spark, f"{root}/out")
