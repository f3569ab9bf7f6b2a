import base64

import pytest

from weir.functions import html
from weir.functions.html import pieces, select_first


def inner(one, page, *selectors):
    from pyspark.sql import functions as F

    def build(h):
        found = select_first(pieces(h), *selectors)
        join = lambda p: F.concat(p["tag"], F.when(p["tag"] != "", ">").otherwise(""), p["text"])
        return F.array_join(F.transform(found, join), "")

    return one(build, page)


PAGE = '<div class="a content"><div id=x>a<div>b</div>c</div><DIV>d</DIV></div>z<div>q</div>'


@pytest.mark.parametrize("selectors, expected", [
    ([".content"], "<div id=x>a<div>b</div>c</div><DIV>d</DIV>"), (["#x"], "a<div>b</div>c"),
    ([".content", "#x"], "a<div>b</div>c"), (["#y"], None), (["div", "div", "div"], "b"), ([".con"], None), (["di"], None),
])
def test_select(one, selectors, expected):
    assert inner(one, PAGE, *selectors) == expected


def test_unclosed_runs_to_the_end(one):
    assert inner(one, "<article><p>a<b>b", "article") == "<p>a<b>b"


def test_main_text_choices(one):
    page = "<body><nav>n</nav>{}</body>"
    assert one(html.main_text, page.format("<main>m</main><article>a</article>")) == "a"
    assert one(html.main_text, page.format('<div class="content">c</div><main>m</main>')) == "m"
    assert one(html.main_text, page.format('<section class="x content y"><section>i</section>c</section>')) == "i\nc"
    assert one(html.main_text, page.format("<p>p</p>")) == "n\np"
    assert one(html.main_text, "bare &lt;b&gt; &amp;amp;") == "bare <b> &amp;"
    assert one(html.main_text, "<article>x<script>'</article>'</script><!-- </article> --><br/>y  \t z\n\n</article>") == "x\ny z"


def test_signs_quotes_and_references(one):
    assert one(html.main_text, "<article>1 < 2 and 3 > 2 ok</article>") == "1 < 2 and 3 > 2 ok"
    assert one(html.main_text, """<article><img alt="a > b" src=x>tail<i title='x > y'>i</i></article>""") == "taili"
    assert one(html.main_text, "<article>it&#8217;s &mdash; caf&eacute; &#x1F600; &amp;lt; &nosuch; &#0; R&D</article>") == "it\u2019s \u2014 caf\u00e9 \U0001f600 &lt; &nosuch; &#0; R&D"
    assert one(html.main_text, "<article>a<noscript>n</noscript><template>t</template><textarea>x</textarea>b</article>") == "ab"
    assert one(html.page_title, "<title>Tom &#38; J&eacute;r&ocirc;me</title>") == "Tom & J\u00e9r\u00f4me"


def test_links_without_end_tags(one):
    found = one(html.same_origin_links, "https://h.org/p", "<a href=/1>one<br><a href=/2>two</a><a href=/3>three<a title='a>b' href='/4'>four</a> <a name=x>no</a>")
    assert [(x["href"], x["text"]) for x in sorted(found, key=lambda x: x["pos"])] == [
        ("https://h.org/1", "one"), ("https://h.org/2", "two"), ("https://h.org/3", "three"), ("https://h.org/4", "four")]


def test_unquoted_image(one):
    assert one(html.walk_with_images, '<div id="js_content"><img src=u.png></div>') == "![image](u.png)"


def test_article_without_closing_sign(one):
    assert one(html.main_text, "<article>a < b <p>c</p></article>") == "a < b\nc"


def test_image_walk(one):
    page = ('<div class="rich_media_content"><p> one <span>two</span></p><img src="s.png"><img data-src="d.png" src="s2.png">'
            "<img alt='none'><!-- no --></div>")
    assert one(html.walk_with_images, page) == "one\n\ntwo\n\n![image](s.png)\n\n![image](d.png)"
    assert one(html.walk_with_images, "<article>plain</article>") == "plain"
    assert one(html.walk_with_images, '<div id="js_content"> </div><article>x</article>') == "x"


def test_note(one):
    page = '<div id="detail-title"> T </div><div id="detail-desc"></div><p class="bottom-container">m</p><i class="interaction-container">a<br>b</i>'
    assert one(html.note_fields, page).asDict() == {"title": "T", "content": "m", "author": "a"}
    assert one(html.note_fields, "<p>x</p>").asDict() == {"title": "", "content": "", "author": ""}


def test_links(one):
    page = ("<a href='/x#1'>one</a><a HREF=/x>two</a><a href=\"http://o.example/\">out</a><a name=q>no</a>"
            "<!-- <a href='/c'>c</a> --><a href='y'>  th\nree <b>!</b></a><abbr href='/no'>n</abbr>")
    got = one(html.same_origin_links, "http://h.example/d/p?q=1", page)
    assert sorted((l["pos"], l["href"], l["text"]) for l in got) == [
        (0, "http://h.example/x", "one"), (3, "http://h.example/d/y", "th ree !")]


def test_scripts(one):
    assert one(html.strip_scripts, "a<SCRIPT type=x>1\n2</script>b<script src=y />c") == "abc"


def test_theme(one):
    page = '<html lang="x" class="light">{color-scheme: light}{color-scheme: light}<html class="light">'
    dark = one(lambda h: html.rewrite_theme(h, "dark"), page)
    assert dark == '<html lang="x" class="dark">{color-scheme: dark}{color-scheme: light}<html class="light">'
    assert one(lambda h: html.rewrite_theme(h, None), page) == page
    assert one(lambda h: html.rewrite_theme(h, "light"), page) == page
    assert one(lambda h: html.rewrite_theme(h, "dark"), '<html class="light big">') == '<html class="light big">'


def test_style_is_taken_literally(one):
    page = 'x<link rel=a href="c(1).css"><LINK href="c(1).css" media=y>'
    got = one(html.inline_style, page, "c(1).css", r"a{content:'\1 $2'}")
    assert got == "x<style>\na{content:'\\1 $2'}\n</style>" + '<LINK href="c(1).css" media=y>'
    assert one(html.inline_style, page, "other.css", "a{}") == page


def test_data_uri_is_one_line(one):
    raw = bytes(range(256)) * 4
    got = one(lambda d: html.data_uri(html.F.lit("image/png"), d), bytearray(raw))
    assert got == "data:image/png;base64," + base64.b64encode(raw).decode()


def test_patterns_in_order(one):
    assert one(lambda h: html.strip_patterns(h, ["<a.*?</a>", "B"]), "x<A\nq</a>by") == "xy"


def test_audio(one):
    page = '"u":"https://media.xyzcdn.net/a/b.m4a","v":"https://media.xyzcdn.net/c.mp3"'
    assert one(html.audio_link, page) == "https://media.xyzcdn.net/a/b.m4a"
    assert one(html.audio_link, "none") == ""
