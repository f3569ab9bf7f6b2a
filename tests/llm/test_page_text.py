import html
import re

import pytest

from weir.llm.page_text import main_text, page_text

EN = "The house on the hill was built by the people of the town and it is as old as the road that leads to it from the river."
DE = "Das Haus auf dem Berg ist von den Leuten der Stadt und es ist so alt wie die Straße, die von dem Fluss auf den Berg geht."


@pytest.mark.parametrize("page, text", [
    (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{EN}</p></article><footer>Legal</footer>", f"Title {EN}"),
    (f"<div class='ad'>{EN}</div><article><header><h1>T</h1></header><p>{EN}<aside>side</aside><p>Short.</article><section id=comments>{EN}</section>", f"T {EN} Short."),
    (f"<body><header>{EN}</header><div><p>{EN} {EN}<p>Short.<p>{EN} {EN}</div><div class='side-bar sidebar'>{EN} {EN}</div></body>", f"{EN} {EN} Short. {EN} {EN}"),
    (f"<p>{DE} {DE}</p><h2>Weiter</h2><p>{DE} {DE}</p><p><a href=x>{DE}</a></p>", f"{DE} {DE} Weiter {DE} {DE}"),
    ("<article><p>1 &lt; 2 and 3 > 2 &amp; caf&eacute; &#8217;s&nbsp;x</p><p title='a > b'>tail</article>", "1 < 2 and 3 > 2 & café ’s x tail"),
    ("<article><p class=notice>buy<p>read</p></article>", "read"),
    ("<article><script>var a = '</p><p>no</p>';</script><style>p{}</style><p>yes</p><form><p>mail</p><input></form></article>", "yes"),
    ("<article><p>a<br>b<b>c</b>d <!-- <p>no</p> --> e\n\t f</article>", "a bcd e f"),
    ("<article><p>x</p></article><article class='comment'><p>c</p></article>", "x"),
    ("<article><p>Para <span class='ad'>buy</span> rest</p><figure><figcaption>cap</figcaption></figure><div class=share-buttons>s</div></article>", "Para rest cap"),
    ("", ""), (None, ""), ("no markup", "no markup"), ("<nav><ul><li><a href=1>x</a></ul></nav>", ""), ("<<<>>> </div></div><p", "<<<>>> <p"),
])
def test_pages(page, text):
    assert page_text(page) == text


def test_long_page_and_deep_nesting():
    assert page_text("<div>" * 5000 + f"<article><p>{EN}</p></article>") == EN
    assert len(page_text("<article>" + f"<p>{EN}</p>" * 20_000 + "</article>")) == 20_000 * (len(EN) + 1) - 1


def test_table_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = main_text(pages).collect()
    assert len(rows) == pages.count()
    source = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        inner = re.search("<article>(.*?)</article>", source[r.page_id], re.S).group(1)
        plain = html.unescape(re.sub("<(?:/?p|/?h1|br)[^>]*>", " ", re.sub("</?b>", "", inner)))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", f"<p>{EN} {EN}</p>", "x"), (1, "u", f"<p>{EN} {EN}</p>", None)],
                                  "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in main_text(pages).collect()] == [(None, "", 0), (1, "", 0)] + [(1, f"{EN} {EN}", 2 * len(EN) + 1)] * 2
    assert main_text(pages.where("false")).count() == 0


LINKS = "".join(f"<a href=/{i}>Another story of the town and of the river {i}</a> " for i in range(4))


@pytest.mark.parametrize("page, text", [
    (f"<main><p>{EN} {EN}</p><p>Short.</p><div>{LINKS}</div></main>", f"{EN} {EN} Short."),
    (f"<main><p>{EN} {EN}</p><h3>More</h3><ul><li>{LINKS}</li></ul></main>", f"{EN} {EN}"),
    (f"<div><p>{EN} {EN}</p><p>Short.</p><p>{EN} {EN} {EN}</p></div><article><p>Read this next</p></article>", f"{EN} {EN} Short. {EN} {EN} {EN}"),
    (f"<div>{EN}</div><article><p>{DE} {DE}</p><p>Kurz.</p></article>", f"{DE} {DE} Kurz."),
])
def test_rules_hold_inside_and_outside_of_articles(page, text):
    assert page_text(page) == text


GOOD = ("This is the first paragraph of the text and it was written for all of those who like to read on, as they are at home with words that "
        "come from the middle of the language and not from its ends, and it is as long as it has to be. ")


@pytest.mark.parametrize("page, text", [
    ("<body><p>Hello world.</p></body>", "Hello world."),
    ("<body><div>One thing.</div><div>Another thing.</div></body>", "One thing. Another thing."),
    ("<html><head><title>T</title><meta charset=utf-8><p>Hello to all.</p>", "Hello to all."),
    (f"<head><title>T</title><style>p {{}}</style><div><p>{GOOD}</p></div>", GOOD.strip()),
    (f"<body><div class='login wide'><p>{GOOD}</p><p>{GOOD}</p></div><div>Log in</div></body>", f"{GOOD}{GOOD}".strip()),
    (f"<body><div class='side-by-side'><p>{GOOD}</p></div><div class='sidebar'>{GOOD}</div></body>", GOOD.strip()),
    (f"<body><div id='comments'><p>{GOOD}</p><p>{GOOD}</p></div><div class='promo'>{GOOD}</div></body>", GOOD.strip()),
    (f"<body><div><p>{GOOD}</p><p>So it ends.</p></div></body>", f"{GOOD}So it ends."),
    ("<body><nav>Home</nav><footer>All rights</footer></body>", ""),
])
def test_no_text_is_lost(page, text):
    """Short pages, heads without an end, articles in elements of doubtful names, last short paragraphs."""
    assert page_text(page) == text
