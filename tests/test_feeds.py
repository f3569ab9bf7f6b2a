from weir.sources.feeds import feed_entries, feed_errors, read_feeds

RSS = """<?xml version="1.0"?><!-- c --><rss version="2.0" xmlns:content="http://c" xmlns:dc="http://d"><channel><title>My &amp; <![CDATA[<Feed>]]></title>
<item><title>One &lt;b&gt;</title><link>https://e.org/1</link><description><![CDATA[<p>sum</p>]]></description><pubDate>Mon</pubDate></item>
<item rdf:about="x"><title>Two</title><content:encoded>full</content:encoded><dc:date>2024</dc:date></item>
<item><title/><description></description><content:encoded>full</content:encoded></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">A</title><entry><title>E</title><link rel="self" href="s"/>
<link rel="alternate" href="https://e.org/e"/><summary>S</summary><updated>2020</updated></entry></feed>"""
BROKEN = "<rss><channel><item><title>ok</title><link>l</link></item><item><title>cut"
EMPTY = "<rss><channel><title>t</title></channel></rss>"


def feeds(spark):
    rows = [("rss", RSS), ("atom", ATOM), ("broken", BROKEN), ("empty", EMPTY), ("none", None)]
    return spark.createDataFrame(rows, "feed_url string, xml string")


def entries(spark, **kw):
    return {(r["feed_url"], r["pos"]): r for r in feed_entries(feeds(spark), **kw).collect()}


def test_formats(spark):
    got = entries(spark)
    assert set(got) == {("rss", 0), ("rss", 1), ("rss", 2), ("atom", 0), ("broken", 0)}
    show = lambda k: tuple(got[k][c] for c in ("source", "title", "summary", "url", "published"))
    assert show(("rss", 0)) == ("My & <Feed>", "One <b>", "<p>sum</p>", "https://e.org/1", "Mon")
    assert show(("rss", 1))[1:] == ("Two", "full", "", "")
    assert show(("atom", 0)) == ("A", "E", "S", "https://e.org/e", "")
    assert show(("broken", 0)) == ("broken", "ok", "", "l", "")


def test_limit_and_errors(spark):
    assert len([k for k in entries(spark, limit=2) if k[0] == "rss"]) == 2
    assert sorted(r["feed_url"] for r in feed_errors(feeds(spark)).collect()) == ["empty", "none"]


def test_references_sections_and_late_titles(spark):
    xml = ("<rss><channel><!-- <item><title>off</title></item> --><item><title>a&nbsp;b &eacute; R&D &amp; c</title><link>l</link>"
           "<description><![CDATA[<item>x &nbsp;</item>]]></description></item><title>Late</title></channel></rss>")
    rows = feed_entries(spark.createDataFrame([("u", xml)], "feed_url string, xml string")).collect()
    assert [(r["source"], r["title"], r["summary"], r["url"]) for r in rows] == [("Late", "a b \u00e9 R&D & c", "<item>x &nbsp;</item>", "l")]


def test_broken_entries_keep_their_place(spark):
    """An entry that is no XML is an error row; the ones around it are read; a title after the entries counts."""
    xml = ("<rss><channel><item><title>a</title></item><item><title><b>x</title></item><item/><item><title>c &amp;amp; &nope;</title><link>l</link></item>"
           "<title>Feed</title></channel></rss>")
    rows = read_feeds(spark.createDataFrame([("u", xml), ("v", "no feed at all")], "feed_url string, xml string")).orderBy("feed_url", "pos").collect()
    assert [(r["pos"], r["source"], r["title"], r["error"]) for r in rows] == [
        (0, "Feed", "a", None), (1, "Feed", None, "undecodable entry"), (2, "Feed", "c &amp; &nope;", None), (None, "v", None, "no entries in feed")]
    assert {(r["feed_url"], r["pos"], r["error"]) for r in feed_errors(spark.createDataFrame([("u", xml)], "feed_url string, xml string")).collect()} == {
        ("u", 1, "undecodable entry")}


def test_feeds_are_read_once(spark):
    plan = read_feeds(feeds(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and "Exchange" not in plan and "Union" not in plan
