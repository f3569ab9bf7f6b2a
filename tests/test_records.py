import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weir.model import RECORD_FIELDS, flat, iso_timestamp, record_columns
from weir.operators import convert
from weir.sinks.exports import record_json, with_json, write_json, write_json_array
from weir.sources.records import load_arrays, read_export, read_inbox_file, records_from_json

AS_OF = "2024-01-31T00:00:00"
NOTE = {"source_type": "manual", "source_name": "manual", "title": "Demo note", "content": "Body text for example.",
        "url": "https://example.org/demo"}


def decode(spark, *objects):
    rows = [(i, o if isinstance(o, str) else json.dumps(o, ensure_ascii=False)) for i, o in enumerate(objects)]
    return records_from_json(spark.createDataFrame(rows, "n int, raw string"), "raw", AS_OF, ["n"])


def test_round_trip_keeps_everything(spark):
    full = {**NOTE, "id": "given", "fetched_at": "2020-01-01T00:00:00.5", "media_type": "image", "media_url": "u", "score": 3,
            "priority": "hot", "category": "c", "tags": ["a", "b"], "processed": True, "digest_date": "d", "title_cn": "标题",
            "content_cn": 'x"\n', "extra": {"duration": 12, "note": "a\"b", "zip": "012", "views": 0, "n": "12", "long": 1234567890123456789,
                                         "f": 1.5, "b": True, "l": [1, "2", None], "o": {"k": 2}, "z": None}}
    out = json.loads(decode(spark, full).select(record_json().alias("j")).first()["j"])
    assert list(out) == RECORD_FIELDS
    assert out == full


def test_defaults_and_derived_id(spark):
    row = decode(spark, {**NOTE, "unknown": 1}).first()
    assert row["error"] is None and row["title"] == "Demo note"
    assert row["id"] == hashlib.md5(NOTE["url"].encode()).hexdigest()[:12]
    assert (row["media_type"], row["priority"], row["score"], row["processed"], row["tags"], row["extra"], row["fetched_at"]) == (
        "text", "normal", 0, False, [], {}, AS_OF)


@pytest.mark.parametrize("change, error", [
    ({"source_type": "bogus"}, "bad source_type: bogus"), ({"media_type": "x"}, "bad media_type: x"),
    ({"priority": "x"}, "bad priority: x"), ({"title": None}, None), ({"url": None}, "no url to derive an id from"),
])
def test_errors(spark, change, error):
    assert decode(spark, {**NOTE, **change}).first()["error"] == error


def test_missing_and_broken(spark):
    short = {k: v for k, v in NOTE.items() if k not in ("title", "url")}
    errors = [r["error"] for r in decode(spark, short, "{broken", "[1]").orderBy("n").collect()]
    assert errors[0] == "missing: title,url" and errors[1] == "undecodable" and errors[2] is not None


def test_empty_url_id(spark):
    assert decode(spark, {**NOTE, "url": ""}).first()["id"] == "d41d8cd98f00"


def test_strict_load_stops(spark):
    df = spark.createDataFrame([("f", json.dumps([NOTE, {**NOTE, "source_type": "bogus"}]))], "file string, raw string")
    assert [r["error"] for r in load_arrays(df, "raw", AS_OF, ["file"]).orderBy("pos").collect()] == [None, "bad source_type: bogus"]
    with pytest.raises(Exception, match="bogus"):
        load_arrays(df, "raw", AS_OF, ["file"], strict=True).collect()


def test_inbox_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([NOTE, NOTE], indent=2))
    (tmp_path / "b.json").write_text('[{"title": "cut')
    rows = read_inbox_file(spark, str(tmp_path), AS_OF)
    assert rows.count() == 2 and rows.filter("error is null").count() == 2
    assert read_inbox_file(spark, str(tmp_path / "none"), AS_OF).count() == 0


def test_json_export_reads_back(spark, tmp_path):
    df = decode(spark, NOTE, {**NOTE, "url": "https://example.org/二"}).select(*RECORD_FIELDS)
    write_json(df, str(tmp_path / "out"))
    back = read_export(spark, str(tmp_path / "out"), AS_OF)
    assert sorted(r["json"] for r in with_json(back).collect()) == sorted(r["json"] for r in with_json(df).collect())


@pytest.mark.parametrize("n", [0, 1, 40])
def test_array_export_is_one_array(spark, tmp_path, n):
    df = spark.range(n, numPartitions=3).select(F.col("id").alias("seq"), *record_columns(AS_OF, title=F.col("id").cast("string")))
    write_json_array(df.orderBy(F.rand(1)), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [r["title"] for r in json.loads(text)] == [str(i) for i in range(n)]
    (tmp_path / "whole.json").write_text(text)
    assert read_inbox_file(spark, str(tmp_path / "whole.json"), AS_OF).count() == n


def test_iso(spark):
    df = spark.sql("select timestamp'2024-01-02 03:04:05' a, timestamp'2024-01-02 03:04:05.00012' b")
    assert tuple(df.select(iso_timestamp(F.col("a")), iso_timestamp(F.col("b"))).first()) == (
        "2024-01-02T03:04:05", "2024-01-02T03:04:05.000120")


def payload(spark, ddl, *values):
    return spark.createDataFrame([values], ddl)


def test_converter_defaults(spark):
    def record(platform, ddl, *values):
        return flat(convert.convert(payload(spark, ddl, *values), platform, AS_OF)).first().asDict()

    t = record("telegram", "text string, channel string", "x" * 150, "ch")
    assert (t["title"], t["url"], t["extra"]) == ("x" * 100, "https://t.me/ch", '{"views":0,"channel_username":"ch"}')
    r = record("rss", "title string, link string, summary string", "t", "https://l", "s")
    assert (r["url"], r["content"], r["score"]) == ("https://l", "s", 0)
    assert record("rss", "title string, link string, url string", "t", "https://l", "")["url"] == ""
    x = record("xhs", "title string, images array<string>", "t", [])
    assert (x["media_type"], x["extra"]) == ("text", '{"likes":0,"collects":0}')
    assert record("xhs", "title string, images array<string>", "t", ["i"])["media_type"] == "image"
    y = record("youtube", "title string", "t")
    assert (y["media_type"], y["extra"], y["media_url"]) == ("video", '{"duration":"","view_count":0}', None)
    m = record("manual", "title string, content string", "Demo", "c")
    assert m["url"] == "manual://" + hashlib.md5(b"Demo").hexdigest()[:8]


def test_router_matches_single_converters(spark):
    ddl = "request_url string, title string, content string, text string, author string"
    rows = [(u, "T", "C", "X", "A") for u in (
        "https://twitter.com/a/status/1", "https://www.bilibili.com/video/BV1q?p=2", "https://Host:1/p", "https://podcasts.apple.com/1")]
    got = {r["request_url"]: r for r in flat(convert.convert_routed(
        spark.createDataFrame(rows, ddl), AS_OF, ["request_url"]), "request_url").collect()}
    tweet = got["https://twitter.com/a/status/1"]
    assert (tweet["source_type"], tweet["url"], tweet["content"]) == ("twitter", "https://x.com/a/status/1", "X")
    video = got["https://www.bilibili.com/video/BV1q?p=2"]
    assert (video["url"], video["extra"]) == ("https://www.bilibili.com/video/BV1q", '{"bvid":"BV1q","duration":0,"view_count":0}')
    page = got["https://Host:1/p"]
    assert (page["source_type"], page["source_name"], page["content"], page["extra"]) == ("manual", "Host:1", "C", "{}")
    assert got["https://podcasts.apple.com/1"]["source_type"] == "manual"


def test_record_columns_cover_the_schema(spark):
    assert spark.range(1).select(*record_columns(AS_OF)).columns == RECORD_FIELDS
