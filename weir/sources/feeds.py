"""RSS, RDF and Atom feeds landed as XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.html import COMMENT, ENTITIES, REFERENCE
from weir.functions.text import let, or_empty, present_once

ENTRY = r"(?s)<(?:\w+:)?(?:item|entry)(?:\s[^>]*)?>.*?</(?:\w+:)?(?:item|entry)\s*>"
TITLE = r"(?s)<(?:\w+:)?title(?:\s[^>]*)?>.*?</(?:\w+:)?title\s*>"
ENTRY_SCHEMA = (
    "title string, link array<struct<_VALUE:string,_href:string,_rel:string>>, description string, "
    "summary string, content array<string>, encoded array<string>, pubDate string, published string, _undecoded string"
)
XML_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_undecoded"}
NO_ENTRIES = "no entries in feed"
BAD_ENTRY = "undecodable entry"
ENTRY_LIMIT = 20


def entry_link(e: Column) -> Column:
    """Text of <link>, else the href of the alternate (or first) Atom link, else ''."""
    plain = F.get(F.filter(e["link"], lambda l: F.coalesce(l["_VALUE"], F.lit("")) != ""), F.lit(0))["_VALUE"]
    alternate = F.filter(e["link"], lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    return or_empty(F.coalesce(plain, F.get(alternate, F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"]))


def entry_summary(e: Column) -> Column:
    """Summary when the entry has one, even an empty one; else the first content; else ''."""
    return or_empty(F.coalesce(e["summary"], e["description"], F.get(e["content"], F.lit(0)), F.get(e["encoded"], F.lit(0))))


def known_references(xml: Column) -> Column:
    """Every reference one that XML knows: named HTML references become numeric ones, a ``&`` that starts none ``&amp;``."""
    codes = F.str_to_map(F.lit(ENTITIES), F.lit(","), F.lit(":"))

    def reference(part: Column) -> Column:
        def fixed(name: Column) -> Column:
            code = F.element_at(codes, name)
            return (
                F.when(name.isin("lt", "gt", "amp", "quot", "apos") | name.startswith("#"), F.concat(F.lit("&"), part))
                .when(code.isNotNull(), F.concat(F.lit("&#"), code, F.substr(part, F.length(name) + 1)))
                .otherwise(F.concat(F.lit("&amp;"), part))
            )

        return let(F.regexp_extract(part, REFERENCE, 1), fixed)

    split = lambda t: F.array_join(F.transform(F.split(t, "&"), lambda p, i: F.when(i == 0, p).otherwise(reference(p))), "")
    return let(xml, lambda t: F.when(t.contains("&"), split(t)).otherwise(t))


def plain_xml(xml: Column) -> Column:
    """The document without CDATA sections and comments; references outside of sections as they were.

    CDATA becomes escaped text, so that markup inside it opens no element.
    """
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    section = lambda p: let(F.substring_index(p, "]]>", 1), lambda data: F.concat(escaped(data), F.substr(p, F.length(data) + 4)))
    joined = lambda t: F.array_join(F.transform(F.split(t, r"<!\[CDATA\["), lambda p, i: F.when(i == 0, p).otherwise(section(p))), "")
    plain = let(xml, lambda t: F.when(t.contains("<![CDATA["), joined(t)).otherwise(t))
    return let(plain, lambda t: F.when(t.contains("<!--"), F.regexp_replace(t, COMMENT, "")).otherwise(t))


def read_feeds(feeds: DataFrame, url: str = "feed_url", xml: str = "xml", limit: int = ENTRY_LIMIT) -> DataFrame:
    """First ``limit`` entries per feed: ``(feed_url, pos, source, title, summary, url, published, error)``.

    Entries are cut out first and only the wanted ones are decoded, so a feed
    that breaks off still gives its whole entries. ``published`` is the entry's own publishing
    date; dates of later changes do not stand in for it. An entry that is no XML has its
    place and an error, a feed without any entry one row without a place. The feeds are read once.
    """
    plain = feeds.select(F.col(url), plain_xml(F.col(xml)).alias(xml))
    entries = F.slice(F.regexp_extract_all(xml, F.lit(ENTRY), F.lit(0)), 1, limit)
    cut = plain.select(F.col(url), F.col(xml), F.coalesce(entries, F.array().cast("array<string>")).alias("_all"))
    # The feed's title mostly stands before the first entry; only else the entries are taken out to look for it.
    before = F.when(F.size("_all") > 0, F.call_function("substring_index", F.col(xml), F.get("_all", F.lit(0)), F.lit(1))).otherwise(F.col(xml))
    rest = F.regexp_replace(F.regexp_replace(xml, ENTRY, ""), r"(?s)<(?:\w+:)?(?:item|entry)[\s>].*$", "")
    title = F.coalesce(present_once(F.regexp_extract(before, TITLE, 0)), F.regexp_extract(rest, TITLE, 0))
    feed_title = F.from_xml(F.concat(F.lit("<feed>"), known_references(title), F.lit("</feed>")), F.lit("title string"), {"ignoreNamespace": "true"})["title"]
    rows = cut.select(F.col(url), F.coalesce(present_once(feed_title), F.col(url)).alias("source"), F.posexplode_outer("_all").alias("pos", "_x"))
    parsed = rows.withColumn("_e", F.from_xml(known_references(F.col("_x")), F.lit(ENTRY_SCHEMA), XML_OPTIONS))
    e = F.col("_e")
    error = F.when(F.col("pos").isNull(), NO_ENTRIES).when(e.isNull() | e["_undecoded"].isNotNull(), BAD_ENTRY)
    value = lambda c: F.when(F.col("error").isNull(), c)
    return parsed.withColumn("error", error).select(
        url, "pos", "source",
        value(or_empty(e["title"])).alias("title"), value(entry_summary(e)).alias("summary"), value(entry_link(e)).alias("url"),
        value(or_empty(F.coalesce(e["pubDate"], e["published"]))).alias("published"), "error",
    )


def feed_entries(feeds: DataFrame, url: str = "feed_url", xml: str = "xml", limit: int = ENTRY_LIMIT) -> DataFrame:
    """The entries of ``read_feeds`` that could be decoded."""
    return read_feeds(feeds, url, xml, limit).filter("error is null").drop("error")


def feed_errors(feeds: DataFrame, url: str = "feed_url", xml: str = "xml", limit: int = ENTRY_LIMIT) -> DataFrame:
    """``(feed_url, pos, error)``: feeds without a single entry, and entries that could not be decoded."""
    return read_feeds(feeds, url, xml, limit).filter("error is not null").select(url, "pos", "error")
