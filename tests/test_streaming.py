from pyspark.sql import functions as F

from weir.operators import reading
from weir.operators.inbox import first_wins
from weir.plans.records import inbox_records
from weir.plans.landed import view
from weir.plans import reads, streams
from weir.plans.reads import landed_requests
from weir.sinks.store import InboxStore
from weir.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rows = inbox_records(view(spark, FOLDER, "v_inbox"))
    drops = str(tmp_path / "drops")
    store = InboxStore(spark, str(tmp_path / "store"))
    total = rows.count()
    for part, (low, high) in enumerate([(0, 70), (70, 140), (140, 10_000)]):
        # Files arrive in seq order; the stream picks up where it stopped.
        rows.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(drops)
        stream = spark.readStream.schema(rows.schema).parquet(drops)
        ingest.run_inbox(stream, store, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    expected = sorted((r["seq"], r["id"]) for r in first_wins(rows).collect())
    assert sorted((r["seq"], r["id"]) for r in store.load().collect()) == expected
    logged = spark.read.text(str(tmp_path / "log")).filter("value like '## %'").count()
    assert logged >= total


def test_replayed_batch_adds_nothing(spark, tmp_path):
    rows = inbox_records(view(spark, FOLDER, "v_inbox"))
    drops = str(tmp_path / "drops")
    rows.write.parquet(drops)
    store = InboxStore(spark, str(tmp_path / "store"))
    for attempt in ("a", "b"):
        stream = spark.readStream.schema(rows.schema).parquet(drops)
        ingest.run_inbox(stream, store, None, str(tmp_path / attempt)).awaitTermination()
    assert store.load().count() == first_wins(rows).count()


def test_bounded_dedup_and_daily_counts(spark, tmp_path):
    drops = str(tmp_path / "drops")
    data = [("a", "rss", "2024-01-01T10:00:00"), ("a", "rss", "2024-01-01T11:00:00"), ("b", "xhs", "2024-01-02T00:00:00"),
            ("c", "rss", "2024-01-05T00:00:00")]
    df = spark.createDataFrame(data, "id string, source_type string, t string").withColumn("at", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(drops)
    stream = lambda: spark.readStream.schema(df.schema).parquet(drops)
    ingest.drain(ingest.bounded_dedup(stream(), "at"), str(tmp_path / "o1"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == ["a", "b", "c"]
    ingest.drain(ingest.daily_source_counts(stream(), "at"), str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "o2")).collect())
    assert got == [("2024-01-01", "rss", 2), ("2024-01-02", "xhs", 1)]


def test_streamed_reading_equals_the_batch_over_several_triggers(spark, tmp_path):
    asked = landed_requests(spark, FOLDER)
    AS_OF = "2024-01-31T00:00:00"
    batch, streamed = InboxStore(spark, str(tmp_path / "a")), InboxStore(spark, str(tmp_path / "b"))
    reading.keep_read(reading.read(asked, AS_OF), batch, str(tmp_path / "log_a"), str(tmp_path / "errors_a"))
    for low in (0, 50, 100, 150):
        asked.filter(F.col("seq").between(low, low + 49)).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    for _ in range(2):  # the second run finds nothing new
        stream = ingest.requests(spark, str(tmp_path / "landed"), 1)
        query = ingest.run_reading(stream, AS_OF, streamed, str(tmp_path / "log_b"), str(tmp_path / "errors_b"), str(tmp_path / "cp"))
        query.awaitTermination()
    assert len(list((tmp_path / "errors_b").glob("batch=*"))) == 4  # a file a trigger
    rows = lambda store: sorted(map(str, store.load().collect()))
    assert rows(batch) == rows(streamed) and batch.load().count() > 50
    errors = lambda name: sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).select("seq", "platform", "error").collect()))
    assert errors("errors_a") == errors("errors_b") and len({e for _, _, e in errors("errors_a")}) >= 5
    lines = lambda name: sorted(r["value"] for r in spark.read.text(str(tmp_path / name)).collect())
    assert lines("log_a") == lines("log_b")


def test_reading_odd_requests(spark):
    rows = [(1, None, "[]"), (2, "x.com/a/status/1", "[]"), (3, "https://x.com/a/status/1", '[null, {"text": "%s"}]' % ("w" * 30)), (4, "https://e.org/", "[null]"),
            (5, "https://e.org/", "nonsense"), (6, "https://e.org/", None), (7, "ftp://e.org/", "[{}]"), (8, "https://e.org/", "[{}]"), (9, "http://[::1]/", "[{}]"),
            (10, "https://x.com/i/web", '[{"text": "t"}, {"text": "%s"}, {"title": "T", "text": "%s"}]' % ("w" * 30, "v" * 101))]
    got = {r["seq"]: r for r in reading.read(spark.createDataFrame(rows, reading.REQUEST_DDL), "2024-01-31T00:00:00").collect()}
    none = "no tier passed: api: no answer; embed: no answer; proxy: no answer; browser: no answer"
    assert {k: r["error"] for k, r in got.items()} == {
        1: "refused: no hostname", 2: none, 3: None, 4: "no tier passed: page: no answer", 5: "undecodable payloads", 6: "no payloads", 7: "refused: unsupported scheme: https"
        if got[7]["error"] == "refused: unsupported scheme: https" else got[7]["error"], 8: None, 9: "refused: private address", 10: None}
    assert (got[3]["source_name"], got[3]["content"], got[3]["reason"]) == ("@a", "w" * 30, "api: no answer")
    assert (got[10]["content"], got[10]["reason"]) == ("v" * 101, "api: no post address; embed: no post address")
    assert got[8]["source_type"] == "manual" and got[8]["source_name"] == "e.org"


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    """Files in any order: kept and late ids together are those of a batch; a replay changes nothing; a hot id is one row."""
    files = [[("a", 20), ("a", 21), ("b", 20)], [("a", 20), ("c", 19), ("d", 1), ("b", 18)], [("d", 25), ("e", 2), ("f", None), ("c", 25)], [("e", 30)]]
    want = {i for rows in files for i, _ in rows}
    for number, order in enumerate(([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1])):
        root = tmp_path / str(number)
        for i in order:
            rows = spark.createDataFrame([(k, d and f"2024-01-{d:02d}") for k, d in files[i]], "id string, t string").selectExpr("id", "to_timestamp(t) as at")
            rows.coalesce(1).write.mode("append").parquet(str(root / "landed"))
        for checkpoint in ("cp", "cp2"):  # the second run replays every batch
            stream = spark.readStream.schema("id string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(root / "landed"))
            ingest.run_dedup(stream, str(root / "out"), str(root / checkpoint), delay="3 days").awaitTermination()
        kept, late = [{r["id"] for r in df.collect()} for df in ingest.read_dedup(spark, str(root / "out"), "id string, at timestamp")]
        assert kept | late == want and not kept & late and late
        if number == 0:
            assert late == {"f"} | ({"e"} - kept) and spark.read.parquet(str(root / "out" / "late")).where("id = 'd'").count() == 1


def _many_files(spark, tmp_path, monkeypatch):
    """A folder whose documents lie in 12 files, and the working folder of the next query over it."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.repartition(12).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    for name in ("labels", "pages", "events", "conversations"):
        (tmp_path / "in" / f"{name}.parquet").symlink_to(f"{FOLDER}/{name}.parquet")
    for module in (reads, streams):
        monkeypatch.setattr(module, "fresh_path", lambda spark, label: str(tmp_path / "work"))
    return str(tmp_path / "in")


def test_drops_land_in_many_files_and_are_one_batch_each(spark, tmp_path, monkeypatch):
    """No task writes or reads a whole drop."""
    folder = _many_files(spark, tmp_path, monkeypatch)
    got = {r["id"] for r in streams.stream_inbox_wm(spark, folder).collect()}
    assert got == {r["id"] for r in inbox_records(view(spark, FOLDER, "v_inbox")).select("id").collect()}
    assert len(list((tmp_path / "work" / "landed").glob("part-*"))) > 12
    assert len(list((tmp_path / "work" / "out" / "marks").glob("batch=*"))) == 3


def test_requests_land_in_many_files_and_the_first_wins(spark, tmp_path, monkeypatch):
    folder = _many_files(spark, tmp_path, monkeypatch)
    got = sorted(map(str, reads.stream_read(spark, folder).collect()))
    assert len(list((tmp_path / "work" / "landed").glob("part-*"))) > 12
    assert len(list((tmp_path / "work" / "errors").glob("batch=*"))) == 3
    monkeypatch.setattr(reads, "fresh_path", lambda spark, label: str(tmp_path / "batch"))
    assert got == sorted(map(str, reads.read_inbox(spark, folder).collect()))
