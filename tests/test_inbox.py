import random
import re
from itertools import takewhile

import pytest
from pyspark.sql import functions as F

from weir.model import record_columns
from weir.operators import channels, inbox
from weir.sinks.exports import write_markdown
from weir.sinks.recent import RecentRecords
from weir.sinks.store import InboxStore

AS_OF = "2024-01-31T00:00:00"


def batch(spark, *rows):
    """rows: (seq, url, fetched_at)"""
    df = spark.createDataFrame([(s, u, f) for s, u, f in rows], "seq bigint, url string, fetched_at string")
    fields = dict(url=F.col("url"), fetched_at=F.col("fetched_at"), title=F.concat(F.lit("t"), F.col("seq")),
                  content=F.lit("c"), source_type=F.lit("manual"), source_name=F.lit("demo"))
    return df.select("seq", *record_columns(AS_OF, **fields))


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_second_add_of_the_same_url_is_refused(spark):
    url = "https://example.org/unique-dedup-demo"
    rows = batch(spark, (1, url, ""), (2, url, ""))
    empty = batch(spark).limit(0)
    flags = {r["seq"]: r["added"] for r in inbox.added_flags(rows, empty).collect()}
    assert flags == {1: True, 2: False}
    assert seqs(inbox.new_records(rows, empty)) == [1]


def test_flags_and_records_agree_with_a_plain_loop(spark):
    rng = random.Random(5)
    # One url makes up a third of all rows.
    pick = lambda: "hot" if rng.random() < 0.34 else f"u{rng.randrange(150)}"
    stored = [(i, pick(), "") for i in range(60)]
    offered = [(100 + i, pick(), "") for i in range(900)]
    rng.shuffle(offered)
    known = {u for _, u, _ in stored}
    expected = []
    for s, u, _ in sorted(offered):
        if u not in known:
            known.add(u)
            expected.append(s)
    store, new = batch(spark, *stored), batch(spark, *offered)
    assert seqs(inbox.added_flags(new, store).filter("added")) == expected
    assert seqs(inbox.new_records(new, store)) == expected


def test_hot_ids_are_cut_before_the_shuffle(spark):
    plan = inbox.first_wins(batch(spark, (1, "a", ""))).repartition(3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_retention_boundaries(spark):
    rows = batch(spark, (1, "a", "2024-01-24T00:00:00"), (2, "b", "2024-01-24T00:00:00.000001"), (3, "c", "2000-01-01T00:00:00"),
                 (4, "d", "2099-01-01T00:00:00"))
    assert seqs(inbox.keep_recent(rows, AS_OF, 7)) == [2, 4]


def test_mark_processed_keeps_the_last_given_date(spark):
    rows = batch(spark, (1, "a", ""), (2, "b", ""), (3, "c", ""))
    ids = {r["seq"]: r["id"] for r in rows.collect()}
    updates = spark.createDataFrame(
        [(ids[1], "d1", 1), (ids[1], "d2", 2), (ids[1], "", 3), (ids[2], None, 1), ("unknown", "x", 1)],
        "id string, digest_date string, update_seq int")
    got = {r["seq"]: (r["processed"], r["digest_date"]) for r in inbox.mark_processed(rows, updates).collect()}
    assert got == {1: (True, "d2"), 2: (True, None), 3: (False, None)}


def test_listing(spark):
    rows = batch(spark, *[(i, f"u{i}", "") for i in range(25)])
    lines = [r["line"] for r in inbox.listing(rows.select("seq", "source_type", "title")).orderBy("position").collect()]
    assert lines[0] == "📦 Inbox: 25 items" and lines[1] == "   1. ✏️ [manual  ] t5" and len(lines) == 21
    assert [r["line"] for r in inbox.listing(rows.limit(0)).collect()] == ["📦 Inbox is empty"]


def test_store_versions(spark, tmp_path):
    store = InboxStore(spark, str(tmp_path / "store"))
    assert store.load().count() == 0
    first = batch(spark, (1, "a", "2000-01-01T00:00:00"), (2, "b", "2099-01-01T00:00:00"), (3, "a", ""))
    store.add(first)
    store.add(first)
    assert seqs(store.load()) == [1, 2]
    store.add(batch(spark, (4, "b", ""), (5, "c", "2099-01-01T00:00:00")))
    assert seqs(store.load()) == [1, 2, 5]
    row = store.load().filter("seq = 2").first()
    store.mark_processed(spark.createDataFrame([(row["id"], "2024-02-01", 1)], "id string, digest_date string, update_seq int"))
    assert seqs(inbox.unprocessed(store.load())) == [1, 5]
    store.clear_old(AS_OF, 7)
    assert seqs(store.load()) == [2, 5] and store.versions() == [1, 2, 3, 4]
    assert store.load().filter("seq = 2").first()["digest_date"] == "2024-02-01"
    assert seqs(store.load(2)) == [1, 2, 5]  # earlier versions stay readable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_source_is_read_alone(spark, tmp_path):
    store = InboxStore(spark, str(tmp_path / "store"))
    store.add(batch(spark, (1, "a", "2024-01-30T00:00:00")))
    assert list((tmp_path / "store" / "content").glob("batch=*/source_type=manual/day=2024-01-30"))
    assert "PartitionFilters: [isnotnull(source_type" in plan(inbox.by_source(store.load(), "manual"))


def test_membership_reads_the_prefixes_of_the_batch(spark, tmp_path):
    """Only ids are read, and only folders whose prefix the batch has."""
    store = InboxStore(spark, str(tmp_path / "store"), prefix=2)
    store.add(batch(spark, *[(i, f"u{i}", "") for i in range(300)]))
    some = batch(spark, (900, "u7", ""), (901, "new", ""))
    text = plan(store.known(some))
    assert re.search(r"PartitionFilters: \[prefix#\w+ IN \(", text) and "content" not in re.search(r"ReadSchema: .*", text).group()
    store.add(some)
    assert seqs(store.load()) == [*range(300), 901]
    other = InboxStore(spark, str(tmp_path / "store"))  # the layout is the store's, not the client's
    other.add(batch(spark, (950, "u8", ""), (951, "new2", "")))
    assert seqs(other.load()) == [*range(300), 901, 951]


def interleaved(store, monkeypatch, first, *others):
    """Run ``first``; the others are published after it has read the store and before it publishes."""
    publish, waiting = InboxStore._publish, list(others)

    def late(self, new):
        while waiting:
            waiting.pop(0)()
        return publish(self, new)

    monkeypatch.setattr(InboxStore, "_publish", late)
    first()
    monkeypatch.setattr(InboxStore, "_publish", publish)


def test_interleaved_changes_lose_nothing(spark, tmp_path, monkeypatch):
    store = InboxStore(spark, str(tmp_path / "store"))
    store.add(batch(spark, (1, "a", "2000-01-01T00:00:00"), (2, "b", "2099-01-01T00:00:00"), (3, "e", "2024-01-24T00:00:01")))
    ids = {r["seq"]: r["id"] for r in store.load().collect()}
    marks = spark.createDataFrame([(ids[2], "2024-02-01", 1), (ids[3], "", 2)], "id string, digest_date string, update_seq int")
    interleaved(store, monkeypatch, lambda: store.clear_old(AS_OF, 7),
                lambda: store.add(batch(spark, (4, "c", "2099-01-01T00:00:00"))), lambda: store.mark_processed(marks))
    got = {r["seq"]: (r["processed"], r["digest_date"]) for r in store.load().collect()}
    assert got == {2: (True, "2024-02-01"), 3: (True, None), 4: (False, None)}
    # Two batches with one and the same record: it comes once.
    interleaved(store, monkeypatch, lambda: store.add(batch(spark, (6, "same", ""), (7, "mine", ""))), lambda: store.add(batch(spark, (5, "same", ""))))
    assert seqs(store.load()) == [2, 3, 4, 5, 7]
    left = {p.name.split("=")[1] for p in (tmp_path / "store" / "content").iterdir()}
    assert {e["folder"] for e in store.snapshot().entries} <= left and len(left) == 5  # four batches and the edge day: beaten attempts leave nothing


def test_marks_write_no_content_and_end_with_their_record(spark, tmp_path):
    store = InboxStore(spark, str(tmp_path / "store"))
    old = batch(spark, (1, "a", "2000-01-01T00:00:00"), (2, "b", "2099-01-01T00:00:00"))
    store.add(old)
    before = {p for p in (tmp_path / "store" / "content").rglob("*.parquet")}
    ids = {r["seq"]: r["id"] for r in old.collect()}
    mark = lambda i, d: store.mark_processed(spark.createDataFrame([(i, d, 1)], "id string, digest_date string, update_seq int"))
    mark(ids[1], "2024-02-01")
    mark(ids[2], "2024-02-02")
    mark(ids[2], "")
    mark("unknown", "2024-02-03")
    assert {p for p in (tmp_path / "store" / "content").rglob("*.parquet")} == before
    store.clear_old(AS_OF, 7)
    store.add(batch(spark, (8, "a", "2099-01-01T00:00:00")))  # the id comes back as a new record
    want = {2: (True, "2024-02-02"), 8: (False, None)}
    assert {r["seq"]: (r["processed"], r["digest_date"]) for r in store.load().collect()} == want
    store.compact()
    store.retire()
    assert {r["seq"]: (r["processed"], r["digest_date"]) for r in store.load().collect()} == want
    assert len(list((tmp_path / "store" / "content").iterdir())) == 1 and len(store.versions()) == 1


def test_retention_drops_days_and_rewrites_one(spark, tmp_path):
    store = InboxStore(spark, str(tmp_path / "store"))
    stamps = ["2024-01-23T23:59:59", "2024-01-24T00:00:00", "2024-01-24T00:00:00.000001", "2024-01-25T00:00:00", "2024-01", "2099", "x"]
    store.add(batch(spark, *[(i, f"u{i}", s) for i, s in enumerate(stamps)]))
    kept = [i for i, s in enumerate(stamps) if s > "2024-01-24T00:00:00"]
    files = {p for p in (tmp_path / "store" / "content").rglob("*.parquet")}
    store.clear_old(AS_OF, 7)
    assert seqs(store.load()) == kept and seqs(store.load(1)) == [*range(len(stamps))]
    assert len({p for p in (tmp_path / "store" / "content").rglob("*.parquet")} - files) == 1
    assert "PartitionFilters: [isnotnull(day" in plan(store.load())
    store.clear_old(AS_OF, 8)  # an earlier cutoff changes nothing
    assert seqs(store.load()) == kept
    store.add(batch(spark, (50, "u0", "2099-02-01"), (51, "u2", "2099")))
    assert seqs(store.load()) == sorted([*kept, 50])


def test_folders_without_a_version_do_not_count(spark, tmp_path):
    store = InboxStore(spark, str(tmp_path / "store"))
    store.add(batch(spark, (1, "a", "")))
    store._write(batch(spark, (2, "b", "")), "00000002-lost", store.snapshot())
    (tmp_path / "store" / "log" / ".unfinished").write_text("{")
    assert store.versions() == [1] and seqs(store.load()) == [1]


def test_markdown_file(spark, tmp_path):
    write_markdown(batch(spark, (1, "https://a", "2024-01-02T03:04:05")).coalesce(1), str(tmp_path / "log"))
    text = "".join(p.read_text() for p in (tmp_path / "log").glob("part-*"))
    assert text == "\n## ✏️ t1\n- Source: demo (manual)\n- URL: https://a\n- Fetched: 2024-01-02T03:04\n\nc\n\n---\n"


def recent(rows, limit, cutoff):
    texts = [r for r in sorted(rows, reverse=True)[:limit] if r[2]]
    return sorted(r[0] for r in takewhile(lambda r: r[1] <= cutoff, texts))


@pytest.mark.parametrize("limit, hours", [(20, 24), (5, 24), (20, 2), (1, 24)])
def test_recent_messages(spark, limit, hours):
    rng = random.Random(limit + hours)
    rows = {c: [(i, rng.randrange(0, 30), rng.choice(["m", "m", "", None])) for i in range(40)] for c in "ab"}
    df = spark.createDataFrame([(c, i, age, t) for c, rs in rows.items() for i, age, t in rs], "channel string, msg_id bigint, age int, text string")
    df = df.withColumn("ts", F.expr(f"timestamp'{AS_OF}' - make_interval(0,0,0,0,age)")).withColumn("views", F.lit(None).cast("int"))
    got = channels.recent_messages(df, AS_OF, limit, hours).collect()
    for c in "ab":
        assert sorted(r["msg_id"] for r in got if r["channel"] == c) == recent(rows[c], limit, hours)
    assert all(r["views"] == 0 and r["url"] == f"https://t.me/{r['channel']}/{r['msg_id']}" for r in got)


def test_recent_records_over_appends(spark, tmp_path):
    recent = RecentRecords(spark, str(tmp_path / "recent"), keep=5)
    assert recent.load(AS_OF).count() == 0
    titles = lambda: [r["title"] for r in recent.load(AS_OF).orderBy("append", "pos").collect()]
    recent.append(batch(spark, *[(i, f"u{i}", "") for i in range(9)]))
    assert titles() == ["t4", "t5", "t6", "t7", "t8"]
    recent.append(batch(spark, (20, "x", ""), (21, "y", "")))
    assert titles() == ["t6", "t7", "t8", "t20", "t21"]
    broken = tmp_path / "recent" / "append=00000003"
    broken.mkdir()
    (broken / "part-0.txt").write_text('[{"title": "cut')
    (tmp_path / "recent" / "append=00000004").mkdir()
    recent.append(batch(spark, (30, "z", "")))
    assert titles() == ["t7", "t8", "t20", "t21", "t30"]
    recent.trim()
    assert titles() == ["t7", "t8", "t20", "t21", "t30"]
    recent.append(batch(spark, *[(40 + i, f"v{i}", "") for i in range(5)]))
    recent.trim()
    assert titles() == [f"t{40 + i}" for i in range(5)] and [p.name for p in (tmp_path / "recent").iterdir()] == ["append=00000006"]


def test_large_limits_move_no_whole_key_into_one_task(spark):
    rows = spark.range(20_000).selectExpr("id as seq", "case when id % 3 > 0 then 'hot' else cast(id % 7 as string) end as k")
    newest = inbox.latest(rows, "k", "seq", 5000)
    assert "hashpartitioning(k#" in plan(newest) and re.search(r"hashpartitioning\(k#\w+, _salt", plan(newest))
    got = newest.groupBy("k").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("_rn").alias("rank")).collect()
    hot = [i for i in range(20_000) if i % 3][-5000:]
    assert {r["k"]: (r["n"], r["low"], r["rank"]) for r in got}["hot"] == (5000, hot[0], 5000)
    assert sum(r["n"] for r in got) == 5000 + len([i for i in range(20_000) if i % 3 == 0])


def test_files_that_are_missing_broken_or_strange(spark, tmp_path):
    from weir.sources.records import read_inbox_files

    good = '{"source_type": "rss", "source_name": "s", "title": "t", "content": "c", "url": "u"}'
    texts = {"a": f"[{good}, {good.replace('rss', 'bogus')}, 5]", "b": f"[{good}", "c": "[]", "d": "", "e": '{"no": "array"'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = read_inbox_files(spark, [str(tmp_path / n) for n in [*texts, "gone"]], AS_OF).collect()
    got = sorted(((r["file"].rsplit("/", 1)[1], r["pos"], r["error"]) for r in rows), key=str)
    assert got == sorted([("a", 0, None), ("a", 1, "bad source_type: bogus"), ("a", 2, "undecodable"), ("b", None, "undecodable file"),
                          ("d", None, "undecodable file"), ("e", None, "undecodable file"), ("gone", None, "no such file")], key=str)
    assert read_inbox_files(spark, [], AS_OF).count() == 0
