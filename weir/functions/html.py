"""HTML functions as Column expressions: selection, text, links, rewriting."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.text import collapse, let, or_empty, present_once, strip
from weir.functions.urls import any_of, origin_of, parts, resolve_in

COMMENT = r"(?s)<!--.*?-->"
CODE = r"(?is)<(?:!--.*?-->|(script|style|noscript|template|textarea)\b.*?</\1\s*>)"
CODE_MARKS = ["<!--", "<s", "<S", "<noscript", "<NOSCRIPT", "<template", "<TEMPLATE", "<textarea", "<TEXTAREA"]
BLOCK_TAGS = "p|div|li|ul|ol|h[1-6]|nav|section|article|main|header|footer|table|tr|blockquote|pre"
LINE_BREAK = rf"(?i)^<(?:br\s*/?$|/?(?:{BLOCK_TAGS})\b)"


# Code point by entity name, as one constant map; a no-break space reads as a space, &apos; is not in the table.
ENTITIES = ",".join(f"{name}:{32 if name == 'nbsp' else code}" for name, code in [*name2codepoint.items(), ("apos", 39)])
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"


def decode_entities(c: Column) -> Column:
    """Named and numeric character references, each decoded once; what is none stays as it is."""
    named = F.str_to_map(F.lit(ENTITIES), F.lit(","), F.lit(":"))

    def one(part: Column) -> Column:
        def replaced(name: Column) -> Column:
            code = (
                F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10))
                .when(name.startswith("#"), F.substr(name, F.lit(2)))
                .otherwise(F.element_at(named, name))
            ).cast("int")
            valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
            sign = F.when(code < 128, F.chr(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
            return F.when(valid, F.concat(sign, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

        return let(F.regexp_extract(part, REFERENCE, 1), replaced)

    decoded = lambda text: F.array_join(F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")
    return let(c, lambda text: F.when(text.contains("&"), decoded(text)).otherwise(text))


def without_code(html: Column) -> Column:
    """Drop comments, scripts, styles and other contents that are never shown; they may hold text that looks like tags."""
    may_hold = lambda h: any_of([h.contains(mark) for mark in CODE_MARKS])
    return let(html, lambda h: F.when(may_hold(h), F.regexp_replace(h, CODE, "")).otherwise(h))


# A tag up to its ``>``, which may also stand inside quoted attribute values.
QUOTED_TAG = r"""(?s)^<[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+(?=>)"""


def pieces(html: Column) -> Column:
    """array(struct(tag, text)): the page cut before every ``<`` that starts a tag.

    ``tag`` is written up to but without its ``>``, ``text`` is what follows.
    Text with no tag in front has tag ''. A ``<`` before anything but a letter,
    ``/``, ``!`` or ``?`` is text. Selection and text extraction work on this
    array, so the page is scanned once however many elements are looked up,
    and patterns run on the short tags only.
    """
    plain = lambda p: F.struct(F.lit("").alias("tag"), p.alias("text"))
    odd = lambda tag, quote: (F.length(tag) - F.length(F.replace(tag, F.lit(quote), F.lit("")))) % 2 == 1
    # Only a tag cut inside a quoted value, so with an odd number of quotes, needs the pattern.
    whole = lambda p, tag: F.when(odd(tag, '"') | odd(tag, "'"), F.coalesce(present_once(F.regexp_extract(p, QUOTED_TAG, 0)), tag)).otherwise(tag)
    parted = lambda p: let(
        let(F.substring_index(p, ">", 1), lambda tag: whole(p, tag)),
        lambda tag: F.struct(tag.alias("tag"), F.substr(p, F.length(tag) + 2).alias("text")),
    )
    return F.transform(
        F.split(html, "(?=<[a-zA-Z/!?])"),
        lambda p: F.when(p.rlike("^<[a-zA-Z/!?]") & p.contains(">"), parted(p)).otherwise(plain(p)),
    )


def select_first(cut: Column, *selectors: str) -> Column:
    """Pieces inside the first element matching one selector; NULL when none matches.

    Selectors: ``tag``, ``#id``, ``.class`` and ``[attr=value]``; several mean
    nested selection. The closing tag is found by counting nesting depth, so
    same-named children do not end the element early.
    """
    for selector in selectors:
        cut = let(cut, _finder(selector))
    return cut


def _opening(selector: str) -> str:
    """Pattern of the opening tag, anchored at the start of a piece."""
    name, attribute, end = "[a-zA-Z][a-zA-Z0-9]*", None, r"""(?=["'\s/]|$)"""
    if selector.startswith("#"):
        attribute = rf"""(?i:id)\s*=\s*["']?{re.escape(selector[1:])}{end}"""
    elif selector.startswith("."):
        attribute = rf"""(?i:class)\s*=\s*["']?(?:[^"']*\s)?{re.escape(selector[1:])}{end}"""
    elif selector.startswith("["):
        key, value = selector[1:-1].split("=")
        attribute = rf"""(?i:{re.escape(key)})\s*=\s*["']?{re.escape(value)}{end}"""
    else:
        name = f"(?i:{selector})"
    return f"^<{name}" + (rf"\s(?:.*?\s)?{attribute}" if attribute else r"(?:[\s/]|$)")


def _likely(selector: str, tag: Column) -> Column:
    """A plain text test that every tag matching the selector passes; patterns then run on those only."""
    if selector[0] in "#.":
        return tag.contains(selector[1:])
    if selector[0] == "[":
        return tag.contains(selector[1:-1].split("=")[1])
    return F.lower(F.left(tag, F.lit(len(selector) + 1))) == f"<{selector}"


def _finder(selector: str):
    opening = "(?s)" + _opening(selector)

    def inside(ps: Column) -> Column:
        matches = lambda p: _likely(selector, p["tag"]) & p["tag"].rlike(opening)
        start = F.array_position(F.transform(ps, matches), F.lit(True))
        return let(start, lambda at: F.when(at > 0, _until_closed(F.slice(ps, at.cast("int"), F.size(ps)))))

    return inside


def _until_closed(ps: Column) -> Column:
    """``ps`` begins with an opening tag; the pieces up to the tag that closes it.

    Depth is counted over the tags of the same name only, which are few.
    """
    name = lambda p: F.lower(F.regexp_extract(p["tag"], "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))

    def same_named(after: Column, tag: Column) -> Column:
        starts = lambda p: F.lower(F.left(p["tag"], F.length(tag) + 2))
        likely = lambda p: starts(p).startswith(F.concat(F.lit("<"), tag)) | (starts(p) == F.concat(F.lit("</"), tag))
        step = lambda p: F.when(p["tag"].startswith("</"), -1).otherwise(1)
        mark = lambda p, i: F.when(likely(p), F.when(name(p) == tag, F.struct(i.alias("at"), step(p).alias("step"))))
        return F.filter(F.transform(after, mark), lambda m: m.isNotNull())

    def cut(all_pieces: Column, tag: Column) -> Column:
        after = F.slice(all_pieces, F.lit(2), F.size(all_pieces))
        state = F.aggregate(
            same_named(after, tag),
            F.struct(F.lit(1).alias("depth"), F.lit(-1).alias("end")),
            lambda acc, m: F.when(acc["end"] >= 0, acc).otherwise(
                F.struct(
                    (acc["depth"] + m["step"]).alias("depth"),
                    F.when(acc["depth"] + m["step"] == 0, m["at"]).otherwise(-1).alias("end"),
                )
            ),
        )
        lead = F.struct(F.lit("").alias("tag"), F.get(all_pieces, F.lit(0))["text"].alias("text"))
        kept = let(state["end"], lambda end: F.when(end >= 0, end).otherwise(F.size(all_pieces)))
        return F.concat(F.array(lead), F.slice(all_pieces, F.lit(2), kept))

    return let(ps, lambda a: let(name(F.get(a, F.lit(0))), lambda tag: cut(a, tag)))


def inner_text(cut: Column) -> Column:
    """Visible text of pieces: blocks become lines, tags go, entities decode, blanks tidy up."""
    shown = lambda p: F.when(p["tag"].rlike(LINE_BREAK), F.concat(F.lit("\n"), p["text"])).otherwise(p["text"])
    text = decode_entities(F.array_join(F.transform(cut, shown), ""))
    # Plain byte searches tell whether a pattern has anything to do.
    holds = lambda t, *marks: any_of([t.contains(m) for m in marks])
    text = let(
        text,
        lambda t: F.when(holds(t, "  ", "\t", "\r", "\f"), F.regexp_replace(t, r"[ \t\r\f]+", " ")).otherwise(t),
    )
    text = let(
        text,
        lambda t: F.when(holds(t, " \n", "\n ", "\n\n"), F.regexp_replace(t, r" ?\n[ \n]*", "\n")).otherwise(t),
    )
    return F.btrim(text, F.lit(" \n"))


def page_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.left(strip(decode_entities(raw)), F.lit(200))


def main_container(cut: Column) -> Column:
    """First of article, main, an element of class content, body, else all."""
    return let(
        cut,
        lambda ps: F.coalesce(
            select_first(ps, "article"), select_first(ps, "main"), select_first(ps, ".content"),
            select_first(ps, "body"), ps,
        ),
    )


def main_text(html: Column) -> Column:
    return inner_text(main_container(pieces(without_code(html))))


def walk_with_images(html: Column) -> Column:
    """Article body as text runs and ``![image](src)`` marks in document order."""
    box = let(
        pieces(F.regexp_replace(html, COMMENT, "")),
        lambda ps: F.coalesce(select_first(ps, "#js_content"), select_first(ps, ".rich_media_content")),
    )
    attribute = lambda tag, key: present_once(unquoted(F.regexp_extract(tag, rf"""(?i)\s{key}\s*=\s*({VALUE})""", 1)))
    source = lambda tag: F.coalesce(attribute(tag, "data-src"), attribute(tag, "src"))
    mark = lambda p: F.when(
        p["tag"].rlike(r"(?i)^<img\b"), F.concat(F.lit("![image]("), decode_entities(source(p["tag"])), F.lit(")"))
    )
    shown = F.flatten(F.transform(box, lambda p: F.array(or_empty(mark(p)), strip(decode_entities(p["text"])))))
    walked = F.array_join(F.filter(shown, lambda t: t != ""), "\n\n")
    return F.coalesce(present_once(walked), main_text(html))


def note_fields(html: Column) -> Column:
    """struct(title, content, author) of a note page, read by its element names."""

    def fields(ps: Column) -> Column:
        author = F.coalesce(
            select_first(ps, ".author-wrapper", ".username"), select_first(ps, ".interaction-container")
        )
        return F.struct(
            or_empty(F.left(inner_text(select_first(ps, "#detail-title")), F.lit(200))).alias("title"),
            F.concat_ws(
                "\n\n",
                present_once(inner_text(select_first(ps, "#detail-desc"))),
                present_once(inner_text(select_first(ps, ".bottom-container"))),
            ).alias("content"),
            or_empty(F.substring_index(inner_text(author), "\n", 1)).alias("author"),
        )

    return let(pieces(without_code(html)), fields)


def post_text(html: Column) -> Column:
    """Text of a post page: the post element, else article, else main, else ''."""
    box = let(
        pieces(without_code(html)),
        lambda ps: F.coalesce(
            select_first(ps, "[data-testid=tweetText]"), select_first(ps, "article"), select_first(ps, "main")
        ),
    )
    return or_empty(inner_text(box))


VALUE = r"""(?s:"[^"]*"|'[^']*'|[^\s"'>]+)"""
HREF = rf"""(?is)\shref\s*=\s*({VALUE})"""


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def anchors(ps: Column) -> Column:
    """array(struct(href, text)) of the links in pieces; a link ends at the next ``<a`` or ``</a``."""
    marks = F.filter(
        F.transform(ps, lambda p, i: F.when(p["tag"].rlike(r"(?i)^</?a(?:[\s/]|$)"), F.struct(i.alias("at"), p["tag"].alias("tag")))),
        lambda m: m.isNotNull(),
    )
    text = lambda a, end: F.array_join(F.transform(F.slice(ps, a + 1, end - a), lambda p: p["text"]), "")
    links = lambda ms: F.filter(
        F.transform(
            ms,
            lambda m, i: F.when(
                m["tag"].rlike(HREF),
                F.struct(
                    F.regexp_extract(m["tag"], HREF, 1).alias("href"),
                    text(m["at"], F.coalesce(F.get(ms, i + 1)["at"], F.size(ps))).alias("text"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return let(marks, links)


def same_origin_links(page_url: Column, html: Column) -> Column:
    """array(struct(href, pos, text)): first link per target on the page's own origin.

    Everything happens inside the row: a sort brings equal targets together, so
    the work per page is n log n and no shuffle is needed.
    """
    links = let(pieces(without_code(html)), anchors)
    target = lambda a: decode_entities(unquoted(a["href"]))
    label = lambda a: strip(collapse(decode_entities(a["text"])))

    def firsts(base: Column, origin: Column) -> Column:
        own = F.filter(
            F.transform(
                links,
                lambda a, i: F.struct(resolve_in(base, origin, target(a)).alias("to"), i.alias("pos"), label(a).alias("text")),
            ),
            lambda x: x["to"]["href"].isNotNull() & (x["to"]["origin"] == origin),
        )
        ordered = F.array_sort(
            F.transform(own, lambda x: F.struct(x["to"]["href"].alias("href"), x["pos"], x["text"]))
        )
        return let(
            ordered,
            lambda links: F.filter(
                links, lambda x, i: (i == 0) | (F.get(links, i - 1)["href"] != x["href"])
            ),
        )

    return let(parts(page_url), lambda base: let(origin_of(base), lambda origin: firsts(base, origin)))


def audio_link(html: Column) -> Column:
    """First audio file address of the podcast host in the page source, else ''."""
    return F.regexp_extract(html, r'https://media\.xyzcdn\.net/[^"\n]+\.(?:m4a|mp3)', 0)


def strip_scripts(html: Column) -> Column:
    html = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>", "")
    return F.regexp_replace(html, r"(?i)<script\b[^>]*/>", "")


def data_uri(content_type: Column, data: Column) -> Column:
    """``data:`` URI on one line; base64() may break lines, those breaks are removed."""
    return F.concat(
        F.lit("data:"), content_type, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"[\r\n]", "")
    )


def strip_patterns(html: Column, patterns: list[str]) -> Column:
    """Remove every match of each caller pattern in turn; dot matches newlines, case is ignored."""
    for pattern in patterns:
        html = F.regexp_replace(html, F.lit("(?is)" + pattern), F.lit(""))
    return html


def rewrite_theme(html: Column, theme: str | None) -> Column:
    """Switch the first class-based root and the first colour scheme to ``theme``; None leaves it."""
    if theme not in ("dark", "light"):
        return html
    other = "light" if theme == "dark" else "dark"
    html = F.regexp_replace(html, rf'(?is)^(.*?<html\b[^>]*\bclass="){other}"', f'$1{theme}"')
    return F.regexp_replace(html, rf"(?s)^(.*?)color-scheme: {other}", f"$1color-scheme: {theme}")


def escape_pattern(c: Column) -> Column:
    r"""Quote text for use inside a pattern (``\Q...\E``)."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def escape_replacement(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit(r"\$"))


def inline_style(html: Column, location: Column, css: Column) -> Column:
    """Replace the first <link> whose href is ``location`` by a <style> block."""
    pattern = F.concat(
        F.lit(r'^(?s)(.*?)(?i)<link\b[^>]*href="'), escape_pattern(location), F.lit(r'"[^>]*>')
    )
    style = F.concat(F.lit("<style>\n"), css, F.lit("\n</style>"))
    return F.regexp_replace(html, pattern, F.concat(F.lit("$1"), escape_replacement(style)))


def replace_all(html: Column, pairs: Column) -> Column:
    """Replace each pair's ``location`` by its ``uri``, in order; empty locations are passed over."""
    return F.aggregate(
        pairs, html,
        lambda h, p: F.when(p["location"] == "", h).otherwise(F.replace(h, p["location"], p["uri"])),
    )
