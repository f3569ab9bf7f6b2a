from urllib.parse import quote, urljoin, urlparse

import pytest

from weir.functions import urls


@pytest.mark.parametrize("url, platform, strict", [
    ("https://mp.weixin.qq.com/s/1", "wechat", "wechat"),
    ("https://netflix.com/title/1", "twitter", "generic"),
    ("https://chat.media.com/1", "telegram", "generic"),
    ("https://X.com/a", "twitter", "twitter"),
    ("https://xhslink.com/a", "xhs", "xhs"),
    ("https://podcasts.apple.com/p", "podcast", "podcast"),
    ("https://a.example.org/?x=/rss", "rss", "rss"),
    ("https://a.example.org/a.XML", "generic", "generic"),
    ("https://a.example.org/youtube.com", "generic", "generic"),
])
def test_platform(one, url, platform, strict):
    assert one(urls.platform, url) == platform
    assert one(lambda u: urls.platform(u, strict=True), url) == strict


@pytest.mark.parametrize("url", [
    "https://User:pw@Host.example.com:8443/a?b=1#c", "http://[::1]:80/x", "https://a.example.org", "https:///x",
    "https://example.org?q", "mailto:a@b.c", "https://例え.jp/é",
])
def test_parts_like_a_url_parser(one, url):
    parsed = urlparse(url)
    assert one(urls.netloc, url) == parsed.netloc.lower()
    assert one(urls.hostname, url) == (parsed.hostname or "")
    assert one(urls.path, url) == parsed.path


@pytest.mark.parametrize("text, expected", [
    ("ftp://h", "https://ftp://h"), ("HTTP://h", "https://HTTP://h"), ("http://h", "http://h"), ("h/x", "https://h/x"),
])
def test_normalise(one, text, expected):
    assert one(urls.normalise, text) == expected


@pytest.mark.parametrize("url, channel", [
    ("https://t.me/chan/12", "chan"), ("https://t.me/s/chan", "s"), ("https://t.me", "https://t.me"),
    ("https://t.me/", "https://t.me/"), ("https://t.me/chan;x", "chan"),
])
def test_channel(one, url, channel):
    assert one(urls.telegram_channel, url) == channel


def test_video_ids(one):
    assert one(urls.bv_id, "https://b23.tv/BVé1_?x") == "BVé1_"
    assert one(urls.bv_id, "https://b23.tv/nothing") == ""
    assert one(urls.bv_id, "BV1xx") == "BV1xx"
    assert one(urls.youtube_id, "https://youtu.be/abc-DEF_123?t=1") == "abc-DEF_123"
    assert one(urls.youtube_id, "https://youtu.be/short") == ""


def test_posts(one):
    assert one(urls.tweet_author, "https://x.com/me/status/9") == "@me"
    assert one(urls.tweet_author, "https://x.com/me") == ""
    assert one(urls.tweet_api_url, "https://x.com/me/status/9") == "https://api.fxtwitter.com/me/status/9"
    assert one(urls.tweet_api_url, "https://x.com/me") is None
    assert one(urls.is_tweet, "https://x.com/me/status/x") is False


@pytest.mark.parametrize("token, expected", [
    ("--json", False), ("--a.b", False), ("www.x", True), ("httpfoo", True), ("a.b", True), ("list", False),
])
def test_candidates(one, token, expected):
    assert one(urls.is_candidate, token) is expected


BASE = "http://u:p@Host.com:80/a/b/c?x#y"


@pytest.mark.parametrize("href", [
    "../d", "./e/", "/f/./g/..", "?q=1", "//o.com/", "k", "../../../z", "a/b/../c", "https://h.com/p", "..", ".", "x/..",
])
def test_resolve_like_a_url_joiner(one, href):
    expected = urljoin("http://host.com/a/b/c?x", href)
    assert one(urls.resolve, BASE, href) == expected


@pytest.mark.parametrize("href, expected", [
    ("#z", "http://host.com/a/b/c?x"), ("", "http://host.com/a/b/c?x"), ("mailto:a@b", None), ("javascript:x()", None),
    ("/é b\"", "http://host.com/%C3%A9%20b%22"), ("http://HOST.com:80", "http://host.com/"), ("  /t\n/u ", "http://host.com/t/u"),
    ("/a%2Fb", "http://host.com/a%2Fb"), ("https://h.com:443/😀", "https://h.com/%F0%9F%98%80"), ("?ä=1", "http://host.com/a/b/c?%C3%A4=1"),
])
def test_resolve_details(one, href, expected):
    assert one(urls.resolve, BASE, href) == expected


@pytest.mark.parametrize("name", ["001-a b.html", "002-中文 +*~'().html", "a/b%c", "😀"])
def test_quote(one, name):
    assert one(urls.quote_file, name) == quote(name)


def test_sql_functions_agree(spark):
    from weir.functions.sql import register
    from weir.model import content_id
    from weir.plans.landed import view

    register(spark)
    df = view(spark, "/root/testdata/sf0.001", "v_urls")
    same = df.selectExpr("url", "detect_platform(url) as p", "content_id(url) as i").filter(
        (urls.F.col("p") != urls.platform(urls.F.col("url"))) | (urls.F.col("i") != content_id(urls.F.col("url"))))
    assert df.count() > 0 and same.count() == 0
