import random
import re
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from weir.operators import archive, fallback, guard, links, numbering, rolling, snapshot, transcripts
from weir.sinks import exports
from weir.sources.files import numbered_lines, subtitle_files


def test_ordinal_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.6 else f"g{rng.randrange(4)}", o) for o in rng.sample(range(10_000), 800)]
    df = spark.createDataFrame(rows, "g string, o bigint")
    got = {(r["g"], r["o"]): r["i"] for r in numbering.add_ordinal(df, ["g"], "o", "i", start=0, block_bits=6).collect()}
    lone = spark.createDataFrame([(None, 3), (None, 500), ("a", 4)], "g string, o bigint")
    assert sorted(r["i"] for r in numbering.add_ordinal(lone, ["g"], "o", "i", block_bits=6).collect()) == [1, 1, 2]
    for g in {g for g, _ in rows}:
        assert [got[(g, o)] for o in sorted(o for x, o in rows if x == g)] == list(range(sum(x == g for x, _ in rows)))


HEADING = re.compile(r"\s*##+\s*(.*?)\s*")
ENTRY = re.compile(r"\s*(https?://.*?)\s*(?: \| \s*(.*?))?\s*")


def parse_lines(lines):
    """Expected entries, from two patterns and a running section."""
    heads = [m and m[1] for m in map(HEADING.fullmatch, lines)]
    sections = list(accumulate(heads, lambda old, new: old if new is None else new, initial=""))[1:]
    found = [(section, *m.groups("")) for section, m in zip(sections, map(ENTRY.fullmatch, lines)) if m]
    return [(n, *entry) for n, entry in enumerate(found, 1)]


def random_list(rng, n):
    kinds = ["https://e.org/{}", " http://e.org/{} | My | T{} ", "## S{}", "###  deep {} ", "# note {}", "", "ftp://x/{}", "#x{}", "  "]
    return [rng.choice(kinds).format(i, i) for i in range(n)]


@pytest.mark.parametrize("bits", [2, 16])
def test_url_list_like_a_line_reader(spark, monkeypatch, bits):
    monkeypatch.setattr(numbering.carry_and_number, "__kwdefaults__", {**numbering.carry_and_number.__kwdefaults__, "block_bits": bits})
    rng = random.Random(bits)
    files = {f: random_list(rng, 200) for f in "pq"}
    df = spark.createDataFrame([(f, i * 3, l) for f, ls in files.items() for i, l in enumerate(ls)], "list string, line_no bigint, line string")
    got = archive.parse_url_list(df).collect()
    for f, ls in files.items():
        assert sorted((r["index"], r["section"], r["url"], r["title"]) for r in got if r["list"] == f) == parse_lines(ls)


def test_large_file_lines_keep_their_order(spark, tmp_path):
    rng = random.Random(3)
    lines = [l + "x" * rng.randrange(60) if l.startswith("http") else l for l in random_list(rng, 30_000)]
    (tmp_path / "list.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.txt").write_text("https://s.org/1\n## s\nhttps://s.org/2\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "131072")
    try:
        df = numbered_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        got = archive.parse_url_list(df, "file").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    of = lambda name: sorted((r["index"], r["section"], r["url"], r["title"]) for r in got if r["file"].endswith(name))
    assert of("list.txt") == parse_lines(lines)
    assert of("small.txt") == [(1, "", "https://s.org/1", ""), (2, "s", "https://s.org/2", "")]


def test_rolling_sum_like_a_double_loop(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("aab"), rng.randrange(4 * 3600) * 1_000_000 + rng.choice([0, 0, 1]), rng.randrange(100)) for i in range(500)]
    rows += [(2000 + i, None, i * 600_000_000, 1) for i in range(20)]
    rows += [(1000, "a", 0, 5), (1001, "a", 3_600_000_000, 7), (1002, "a", 3_600_000_001, 9)]
    df = spark.createDataFrame(rows, "n int, k string, us bigint, v int").withColumn("ts", F.timestamp_micros("us"))
    got = {r["n"]: r["s"] for r in rolling.rolling_sum(df, "k", "ts", "v", "s", 3600, 60).collect()}
    for n, k, us, _ in rows:
        assert got[n] == sum(v for _, k2, us2, v in rows if k2 == k and us - 3_600_000_000 <= us2 <= us)
    assert len(got) == len(rows)


def test_archive_run(spark, tmp_path):
    lines = ["## One & <two>", "https://e.org/1", "https://e.org/2 | Second", "## Other", "https://e.org/3", "https://e.org/4 | Four"]
    entries = archive.parse_url_list(spark.createDataFrame([("l", i, t) for i, t in enumerate(lines)], "list string, line_no bigint, line string"))
    names = ["002-b-c.html", "002-zz.html", "0001-no.html", "001.html", "003-x.txt", "x004-y.html"]
    existing = spark.createDataFrame([("l", n) for n in names], "list string, file string")
    captures = spark.createDataFrame([("l", 1, 'A/"b"', None), ("l", 2, "ignored", None), ("l", 3, "T", "timeout")],
                                     "list string, index bigint, page_title string, capture_error string")
    done = archive.finish(archive.resume(entries, existing), captures)
    rows = {r["index"]: (r["title"], r["file"], r["status"], r["error"]) for r in done.collect()}
    assert rows == {1: ('A/"b"', "001-A--b-.html", "ok", None), 2: ("Second", "002-b-c.html", "skip", None),
                    3: ("", "", "fail", "timeout"), 4: ("Four", "", "fail", "no capture")}
    page = [r["html"] for r in archive.index_lines(done).orderBy("section_pos", "line_pos").collect()]
    assert page == ["<h2>One &amp; &lt;two&gt;</h2>", "<ol>", '<li><a href="./001-A--b-.html">A/&quot;b&quot;</a></li>',
                    '<li><a href="./002-b-c.html">Second</a></li>', "</ol>", "<h2>Other</h2>", "<ol>",
                    '<li class="fail">https://e.org/3 — 失败</li>', '<li class="fail">Four — 失败</li>', "</ol>"]
    stats = archive.run_stats(done).first()
    assert (stats["n_total"], stats["n_ok"], stats["n_fail"]) == (4, 2, 2)
    exports.write_index(archive.index_page(done, theme="light"), str(tmp_path / "index"))
    files = sorted((tmp_path / "index" / "list=l").glob("part-*"), key=lambda p: p.name)
    written = "".join(p.read_text() for p in files)
    assert written.startswith('<!doctype html>\n<html lang="zh-CN">\n<head>\n<meta charset="utf-8">\n<title>归档索引 · 2 篇</title>\n<style>\nbody{background:#ffffff')
    assert written.endswith('成功 2 · 失败 2 · 主题 light</p>\n' + "\n".join(page) + "\n</body>\n</html>\n")


@pytest.mark.parametrize("ip, blocked", [
    ("127.0.0.1", True), ("10.255.255.255", True), ("11.0.0.0", False), ("172.15.255.255", False), ("172.16.0.0", True),
    ("172.31.255.255", True), ("172.32.0.0", False), ("192.168.1.1", True), ("169.254.169.254", True), ("8.8.8.8", False),
    ("::1", True), ("::2", False), ("fd00::1", True), ("FDff:1::", True), ("fc00::1", False), ("2001:db8::1", False),
    ("::ffff:127.0.0.1", False), ("fd12:3456:789a:1::1", True), ("1:2:3:4:5:6:7:8", False), ("fe80::1%eth0", False),
])
def test_networks(one, ip, blocked):
    assert one(guard.in_networks, ip) is blocked


def test_ipv6_digits(one):
    import ipaddress

    for ip in ["::", "::1", "1::", "2001:db8::8:800:200c:417a", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8"]:
        assert one(guard.ipv6_hex, ip) == f"{int(ipaddress.ip_address(ip)):032x}"


@pytest.mark.parametrize("url, reason", [
    ("https://localhost/foo", "reserved hostname"), ("https://a.localhost", "reserved hostname"), ("https://notlocalhost", None),
    ("https://metadata.google.internal/x", "reserved hostname"), ("ftp://e.org", "unsupported scheme: ftp"), ("https:///x", "no hostname"),
    ("https://a_b.org", "invalid hostname characters"), ("https://例え.jp/", None), ("https://☃.net", "invalid hostname characters"),
    ("https://u:p@E.org:1/x", None), ("http://[::1]/", None),
])
def test_guard_reasons(one, url, reason):
    assert one(guard.guard_reason, url) == reason


def test_address_guard(spark):
    df = spark.createDataFrame([(u,) for u in ["http://a/", "http://B/", "http://c/", "http://10.0.0.1/", "http://[::1]/", "http://9.9.9.9"]], "url string")
    dns = spark.createDataFrame([("a", "8.8.8.8"), ("a", "10.1.1.1"), ("b", "8.8.4.4"), ("b", "2001:db8::1")], "host string, ip string")
    got = {r["url"]: r["reason"] for r in guard.with_address_guard(df, dns).collect()}
    assert got == {"http://a/": "private address", "http://B/": None, "http://c/": "cannot resolve hostname",
                   "http://10.0.0.1/": "private address", "http://[::1]/": "private address", "http://9.9.9.9": None}


def test_post_tiers(spark):
    long, mid = "y" * 150, "z" * 30
    tweet, profile = "https://twitter.com/me/status/1", "https://x.com/me"
    rows = [
        (1, tweet, 1, "t1", f" {mid} ", "@api"), (1, tweet, 2, "t2", long, "e"),
        (2, tweet, 1, "t1", "  ", "@api"), (2, tweet, 2, "t2", "x" * 21, "e"), (2, tweet, 3, "t3", long, None),
        (3, tweet, 2, "t2", "https://T.co/abc and more text here", "e"), (3, tweet, 3, "Title: X", long, None), (3, tweet, 4, "t4", mid, None),
        (4, profile, 1, "t1", long, "@api"), (4, profile, 3, "P", long, None),
        (5, tweet, 3, "X", long, None), (5, tweet, 4, "t4", "short", None),
        (6, "https://x.com/i/web", 4, "t4", mid, "nobody"),
    ]
    df = spark.createDataFrame(rows, "item int, url string, tier int, title string, text string, author string")
    got = {r["item"]: (r["ok"], r["tier"], r["title"], r["text"], r["author"]) for r in fallback.choose_post(df).collect()}
    assert got == {1: (True, 1, "t1", mid, "@me"), 2: (True, 2, "t2", "x" * 21, "@me"), 3: (True, 4, "t4", mid, "@me"),
                   4: (True, 3, "P", long, ""), 5: (False, None, None, None, None), 6: (True, 4, "t4", mid, "")}
    asked = spark.createDataFrame([(i,) for i in range(1, 8)], "item int")
    why = {r["item"]: r["reason"] for r in fallback.choose_post(df.unionByName(df), asked).collect()}
    assert why == {1: None, 2: "api: empty", 3: "api: no answer; embed: thin card; proxy: empty title", 4: "api: no post address; embed: no answer",
                   5: "api: no answer; embed: no answer; proxy: empty title; browser: too short", 6: "api: no answer; embed: no answer; proxy: no answer",
                   7: "api: no answer; embed: no answer; proxy: no answer; browser: no answer"}


def test_snapshot_repeated_locations(spark):
    parts = [(1, 0, "", "image/png", b"x"), (1, 1, "main", "text/html", b'<link href="a.css">i.png<script>1</script> cid:2'), (1, 2, "a.css", "text/css", b"old"),
             (1, 3, "i.png", "image/png", b"1"), (1, 4, "a.css", "text/css", b"url(i.png)"), (1, 5, "i.png", "image/gif", b"2"),
             (1, 6, "cid:2", "text/html", b"f"), (2, 1, "a", "text/css", b"")]
    df = spark.createDataFrame(parts, "page_id int, part_no int, location string, content_type string, data binary")
    got = {r["page_id"]: r for r in snapshot.inline(snapshot.gather_parts(df), None).collect()}
    assert got[1]["page_html"] == "<style>\nurl(data:image/gif;base64,Mg==)\n</style>data:image/gif;base64,Mg== data:text/html;base64,Zg=="
    assert got[2]["page_html"] is None and got[2]["error"] == "no main html part"
    assert [c["location"] for c in got[1]["resources"]] == ["", "i.png", "cid:2"]


def test_a_transcript_is_one_row(spark):
    df = spark.createDataFrame([("v", i * 3000, f"t{i}") for i in range(10)], "v string, i bigint, text string")
    got = {r["v"]: r["transcript"] for r in transcripts.concat_segments(df, "v", "i", separator=" ").collect()}
    assert got == {"v": " ".join(f"t{i}" for i in range(10))}


def test_snapshot_passes_over_empty_parts(spark):
    parts = [(1, 1, "x", "text/html", None), (1, 2, None, "text/html", b"<p>a.png b.png</p>"), (1, 3, None, "image/png", b"1"), (1, 4, "a.png", None, None),
             (1, 5, "b.png", "image/png", b"2")]
    df = spark.createDataFrame(parts, "page_id int, part_no int, location string, content_type string, data binary")
    assert snapshot.inline(snapshot.gather_parts(df), None).first()["page_html"] == "<p>a.png data:image/png;base64,Mg==</p>"


def test_index_keeps_rows_without_keys(spark):
    rows = [(None, None, 1, "u", "t", "f", "ok"), ("r", None, 1, "v", "t", "f", "ok")]
    df = spark.createDataFrame(rows, "list string, section string, index bigint, url string, title string, file string, status string")
    assert sum(r["html"].startswith("<li>") for r in archive.index_lines(df).collect()) == 2


def test_preflight_checks_addresses(spark):
    df = spark.createDataFrame([("a", "http://10.0.0.5/"), ("b", "http://[::1]/"), ("c", "http://8.8.8.8/"), ("d", "http://in.side/"), ("e", "http://out.side/")], "run string, url string")
    dns = spark.createDataFrame([("in.side", "192.168.1.1"), ("out.side", "93.184.216.34")], "host string, ip string")
    alone = {r["run"]: r["may_run"] for r in guard.preflight(df, "run").collect()}
    assert alone == {"a": False, "b": False, "c": True, "d": True, "e": True}
    assert {r["run"] for r in guard.preflight(df, "run", dns).collect() if r["may_run"]} == {"c", "e"}


def test_failed_browsers_and_missing_items(spark):
    schema = "item int, url string, final_url string, has_session boolean, tier int, title string, content string, author string"
    rows = [(1, "u", "u", True, 2, "t", None, "a"), (2, "u", "u", True, 2, "t", "text", "a")]
    items = spark.createDataFrame([(1,), (2,), (3,)], "item int")
    for choose in (fallback.choose_article, fallback.choose_note):
        got = {r["item"]: r["ok"] for r in choose(spark.createDataFrame(rows, schema), items).collect()}
        assert got == {1: False, 2: True, 3: False}


def test_video_transcripts_do_not_multiply(spark):
    text = lambda *t: spark.createDataFrame([("https://youtu.be/x", x) for x in t], "url string, transcript string")
    pages = spark.createDataFrame([("https://youtu.be/x", "t", "c")], "url string, title string, content string")
    rows = fallback.choose_video_text(pages, text("a", "longer"), text("b", "c")).collect()
    assert [r["description"] for r in rows] == ["longer"]


def test_videos_without_a_page_come_back(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "url string, transcript string")
    pages = spark.createDataFrame([(u, "t", "page") for u in "abc"], "url string, title string, content string")
    asked = spark.createDataFrame([(u,) for u in "abcd"], "url string")
    rows = fallback.choose_video_text(pages, df(("a", "sub"), ("b", ""), ("d", "x")), df(("b", "said")), items=asked).collect()
    assert {r["url"]: (r["ok"], r["description"], r["has_transcript"], r["reason"]) for r in rows} == {
        "a": (True, "sub", True, None), "b": (True, "said", True, "subtitles: empty"), "c": (True, "page", False, "subtitles: empty; speech: empty"),
        "d": (False, None, False, "page: no answer")}


def test_notes_say_why(spark):
    schema = "item int, url string, final_url string, has_session boolean, tier int, title string, content string, author string"
    wall = "登录后推荐更懂你的笔记"
    rows = [(1, "u", "u", False, 1, "t", wall, "a"), (1, "u", "u", False, 2, "t", "x", "a"), (2, "u", "u", None, 1, "t", "", "a"),
            (2, "u", "https://h/login", True, 2, "t", "x", "a"), (3, "u", "u", True, 2, "t", "x", "a")]
    got = {r["item"]: (r["tier"], r["reason"]) for r in fallback.choose_note(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (None, "proxy: login wall; browser: no session"), 2: (None, "proxy: empty; browser: session expired"), 3: (2, "proxy: no answer")}


def test_items_without_subtitles_stay(spark):
    files = spark.createDataFrame([(1, "s.en.srt", "a"), (2, "s.fr.srt", "b")], "v int, name string, body string")
    items = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    got = {r["v"]: r["name"] for r in transcripts.pick_subtitles(files, "v", ["en"], items=items).collect()}
    assert got == {1: "s.en.srt", 2: None, 3: None}


def test_subtitle_files(spark, tmp_path):
    for name in ["sub.en.vtt", "sub.en.srt", "sub.zh.srt"]:
        (tmp_path / name).write_text(f"1\n{name}\n")
    files = subtitle_files(spark, str(tmp_path)).withColumn("v", F.lit(1))
    assert transcripts.pick_subtitles(files, "v", ["en"]).first()["name"] == "sub.en.srt"
    assert transcripts.pick_subtitles(files, "v", ["zh-Hans", "zh", "en"]).first()["name"] == "sub.zh.srt"
    assert transcripts.pick_subtitles(files, "v", ["fr"]).count() == 0


def test_link_lists_merge_by_first_mention(spark):
    df = lambda n, *hrefs: spark.createDataFrame([(n, i, h, f"{n}{h}") for i, h in enumerate(hrefs)], "n int, pos int, href string, text string")
    got = links.merge(df(2, "a", "b"), df(1, "b", "c"), order=["n", "pos"]).collect()
    assert sorted((r["href"], r["text"]) for r in got) == [("a", "2a"), ("b", "1b"), ("c", "1c")]


def test_archive_run_end_to_end(spark, tmp_path):
    """A run with a refused address or without any writes no entry; files that are there are kept; failures are entries."""
    text = {"good": "## S\nhttps://e.org/1 | One\nhttps://e.org/2\nhttps://e.org/3\nhttps://e.org/4", "bad": "https://e.org/1\nhttp://10.0.0.1/", "none": "# only words"}
    lines = spark.createDataFrame([(r, i, x) for r, t in text.items() for i, x in enumerate(t.split("\n"))], "list string, line_no bigint, line string")
    existing = spark.createDataFrame([("good", "002-old.html"), ("bad", "001-x.html")], "list string, file string")
    captures = spark.createDataFrame([("good", 1, "t1", None), ("good", 2, "t2", None), ("good", 3, "t3", None), ("good", 4, "t4", "timeout"), ("bad", 0, "b", None)],
                                     "list string, line_no bigint, page_title string, capture_error string")
    parts = spark.createDataFrame([("good", 1, 1, "m", "text/html", b"<p>one</p>"), ("good", 2, 1, "m", "text/html", b"x"), ("good", 3, 1, "m", "image/png", b"x"),
                                   ("good", 4, 1, "m", "text/html", b"x"), ("bad", 0, 1, "m", "text/html", b"x")],
                                  "list string, line_no bigint, part_no int, location string, content_type string, data binary")
    path = str(tmp_path / "run")
    runs = {r["list"]: (r["n_urls"], r["n_ok"], r["n_fail"], r["error"]) for r in archive.archive_run(lines, existing, captures, parts, path, theme=None).collect()}
    assert runs == {"good": (4, 2, 2, None), "bad": (2, None, None, "1 addresses refused"), "none": (0, None, None, "no URLs found")}
    entries = {(r["list"], r["index"]): (r["status"], r["file"], r["error"]) for r in spark.read.parquet(f"{path}/entries").collect()}
    assert entries == {("good", 1): ("ok", "001-One.html", None), ("good", 2): ("skip", "002-old.html", None),
                       ("good", 3): ("fail", "", "no main html part"), ("good", 4): ("fail", "", "timeout")}
    assert [(r["file"], r["page_html"]) for r in spark.read.parquet(f"{path}/pages").collect()] == [("001-One.html", "<p>one</p>")]
    assert [p.name for p in (tmp_path / "run" / "manifest").glob("list=*")] == ["list=good"]
    assert "<li class=\"fail\">" in "".join(p.read_text() for p in sorted((tmp_path / "run" / "index" / "list=good").glob("part-*")))
