import re

import pytest

from weir.functions import gates, media, text


@pytest.mark.parametrize("body, title, content", [
    ("# Hello\n\nbody\n", "Hello", "body"),
    ("###\n# Real\nx", "Real", "x"),
    ("\n\n  ## Second", "Second", ""),
    ("a\n  ## b", "a", "## b"),
    ("a" * 300 + "\nz", "a" * 200, "z"),
    ("", "", ""),
    ("###", "", ""),
    ("one\n###\ntwo", "one", "###\ntwo"),
    ("#　\n#a", "a", ""),
])
def test_markdown(one, body, title, content):
    got = one(text.markdown_parts, body)
    assert (got["title"], got["content"]) == (title, content)


SPEECH = re.compile(r"(?!\[.*\]$)(?!.*-->).+")


def spoken(body):
    trimmed = map(str.strip, re.split(r"\r\n|\r|\n", body))
    return " ".join(dict.fromkeys(t for t in trimmed if SPEECH.fullmatch(t) and not t.isdigit()))


@pytest.mark.parametrize("body", [
    "1\n00:00 --> 00:01\nHi\n\n2\n00:01 --> 00:02\n[Music]\nHi\nthere \r\nHi",
    "WEBVTT\n\n１２\n²\nx[y]\n[y]x\n　z　\rq", "", "\n\n",
])
def test_subtitles(one, body):
    assert one(text.subtitle_transcript, body) == spoken(body)


def test_tags_leave_entities(one):
    assert one(text.strip_tags, "<p>a<br>b</p>\n &mdash; <a href='x'>c</a>") == "a b &mdash; c"


def test_image_proxy(one):
    got = one(text.proxy_images, "![](https://mmbiz.qpic.cn/a/640) http://mmbiz.qpic.cn/b https://o.example/x")
    assert got == "![](https://wsrv.nl/?url=https://mmbiz.qpic.cn/a/640) https://wsrv.nl/?url=http://mmbiz.qpic.cn/b https://o.example/x"


@pytest.mark.parametrize("title, name", [
    ('a/b\\c:d*e?f"g<h>i|j', "a-b-c-d-e-f-g-h-i-j"), ("  a \n\t b ", "a b"), ("", "untitled"), ("   ", "untitled"), ("x" * 120, "x" * 110),
])
def test_safe_name(one, title, name):
    assert one(text.safe_name, title) == name
    assert one(lambda t: text.numbered_name(text.F.lit(7), t), title) == f"007-{name}.html"
    assert one(lambda t: text.numbered_name(text.F.lit(1234), t), title).startswith("1234-")


def test_title_from_name(one):
    assert one(text.title_from_name, "012-a-b.c.html") == "a-b.c"
    assert one(text.title_from_name, "plain.html") == "plain"


def test_escape(one):
    assert one(text.escape_html, "<a href=\"x\">'&'</a>") == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"


@pytest.mark.parametrize("n, thin", [(20, True), (21, False)])
def test_thin_gate_boundary(one, n, thin):
    assert one(gates.embed_post_thin, " " + "x" * n + " ") is thin
    assert one(gates.browser_post_ok, "x" * n) is (not thin)


@pytest.mark.parametrize("n, ok", [(100, False), (101, True)])
def test_proxy_gate_boundary(one, n, ok):
    assert one(gates.proxy_post_ok, "x" * n + "  ", "T") is ok
    assert one(gates.proxy_post_ok, "x" * n, "TITLE: X") is False


def test_session_gate(one):
    assert one(gates.session_expired, "https://n/1", "https://n/explore/") is True
    assert one(gates.session_expired, "https://n/1", "https://n/explore/1") is False
    assert one(gates.session_expired, "https://n/login", "https://n/login") is False
    assert one(gates.session_expired, "https://n/1", None) is False


@pytest.mark.parametrize("duration, size, cuts", [
    (1500, 25_000_001, [(0, 600), (600, 600), (1200, 300)]), (1200, 25_000_001, [(0, 600), (600, 600)]),
    (1500, 25_000_000, [(0, 1500)]), (0, 30_000_000, []),
])
def test_segments(one, duration, size, cuts):
    got = one(lambda d, s: media.segments(d.cast("bigint"), s), duration, size)
    assert [(s["start_sec"], s["length_sec"]) for s in got] == cuts
