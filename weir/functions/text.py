"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as blank when trimming.
BLANKS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"
# Digits outside the decimal-number class that still make a line "all digits".
OTHER_DIGITS = "²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐"

# Emoji by source type.
EMOJI = {
    "telegram": "📢", "rss": "📰", "bilibili": "🎬", "xhs": "📕",
    "twitter": "🐦", "wechat": "💬", "youtube": "▶️", "manual": "✏️",
}
EMOJI_DEFAULT = "📄"
IMAGE_PROXY = "https://wsrv.nl/?url="


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``.

    Without it every use repeats the whole expression tree, in the plan and at run time.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of blank on both ends."""
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Runs of blanks become one space."""
    return F.regexp_replace(c, BLANK_RUN, " ")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def present(c: Column) -> Column:
    """Empty text becomes NULL, so that coalesce() picks the next choice.

    For plain columns; nullif() evaluates its input twice, so computed text
    goes through present_once().
    """
    return F.nullif(c, F.lit(""))


def present_once(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def strip_tags(c: Column) -> Column:
    """Tags become spaces, blanks collapse; entities are left as they are."""
    return strip(collapse(F.regexp_replace(c, r"<[^>]+>", " ")))


def markdown_parts(c: Column) -> Column:
    """struct(title, content): first line with words is the title, the rest the content.

    Leading lines made of ``#`` and blanks only never hold a title and are dropped.
    """
    body = F.regexp_replace(strip(c), r"(?U)^(?:#*+[\s\x1c-\x1f&&[^\n]]*+\n)++", "")

    def parts(text: Column) -> Column:
        first = F.substring_index(text, "\n", 1)
        title = F.left(strip(F.ltrim(first, F.lit("#"))), F.lit(200))
        rest = strip(text.substr(F.length(first) + 1, F.length(text)))
        return F.struct(title.alias("title"), rest.alias("content"))

    return let(body, parts)


def is_spoken(line: Column) -> Column:
    """A trimmed subtitle line that holds speech: no number, no timing, no [cue]."""
    return (
        (line != "")
        & ~line.contains("-->")
        & ~line.rlike(f"(?U)^[\\d{OTHER_DIGITS}]+$")
        & ~(line.startswith("[") & line.endswith("]"))
    )


def subtitle_lines(c: Column) -> Column:
    """Spoken lines of one subtitle file, in order, each kept once."""
    lines = F.transform(F.split(c, r"\r\n|\r|\n"), strip)
    return F.array_distinct(F.filter(lines, is_spoken))


def subtitle_transcript(c: Column) -> Column:
    return F.array_join(subtitle_lines(c), " ")


def proxy_images(c: Column) -> Column:
    """Send images of a host that refuses foreign pages through the image proxy."""
    return F.regexp_replace(c, r"(?U)(https?://mmbiz\.qpic\.cn/[^\s)]+)", IMAGE_PROXY + "$1")


def safe_name(c: Column) -> Column:
    """A file name: reserved characters to dashes, blanks collapsed, 110 characters."""
    dashed = F.regexp_replace(or_empty(c), r'[\\/:*?"<>|]', "-")
    short = F.left(collapse(strip(dashed)), F.lit(110))
    return F.coalesce(present_once(short), F.lit("untitled"))


def numbered_name(index: Column, title: Column) -> Column:
    return F.concat(number_prefix(index), safe_name(title), F.lit(".html"))


def number_prefix(index: Column) -> Column:
    """At least three digits and a dash; longer numbers are not cut."""
    return F.concat(F.format_string("%03d", index.cast("bigint")), F.lit("-"))


def title_from_name(name: Column) -> Column:
    """The file stem after its first dash, or the whole stem."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"(?s)^[^-]*-", "")


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def emoji(source_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in EMOJI.items() for x in pair))
    return F.coalesce(F.try_element_at(table, source_type), F.lit(EMOJI_DEFAULT))


def listing_line(position: Column, source_type: Column, title: Column) -> Column:
    return F.concat(
        F.lit("  "), F.format_string("%2d", position.cast("bigint")), F.lit(". "), emoji(source_type),
        F.lit(" ["), F.format_string("%-8s", source_type), F.lit("] "), F.left(title, F.lit(50)),
    )


def markdown_entry(title, source_name, source_type, url, fetched_at, content) -> Column:
    """One entry of the Markdown log; content is capped at 2000 characters as the log defines."""
    return F.concat(
        F.lit("\n## "), emoji(source_type), F.lit(" "), title,
        F.lit("\n- Source: "), source_name, F.lit(" ("), source_type,
        F.lit(")\n- URL: "), url,
        F.lit("\n- Fetched: "), F.left(fetched_at, F.lit(16)),
        F.lit("\n\n"), F.left(content, F.lit(2000)), F.lit("\n\n---\n"),
    )
