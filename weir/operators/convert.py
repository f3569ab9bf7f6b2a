"""Payload-to-record converters and the router that applies all of them in one pass.

Each converter takes the payload columns it knows; a column that is missing or
NULL takes the converter's default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import urls
from weir.functions.text import present
from weir.model import json_value, record_columns

TITLE_CAP = 100


class Payload:
    """Column lookup with defaults over a DataFrame's columns."""

    def __init__(self, df: DataFrame):
        self.names = set(df.columns)

    def get(self, name: str, default="") -> Column:
        fallback = default if isinstance(default, Column) else F.lit(default)
        return F.coalesce(F.col(name), fallback) if name in self.names else fallback

    def optional(self, name: str) -> Column:
        return F.col(name).cast("string") if name in self.names else F.lit(None).cast("string")


def _extra(**values: Column | tuple[Column, str]) -> Column:
    """The open map; a value may come with the text that stands in for NULL."""
    def typed(value: Column | tuple[Column, str]) -> Column:
        if isinstance(value, tuple):
            return F.when(value[0].isNotNull(), json_value(value[0])).otherwise(json_value(F.lit(value[1])))
        return json_value(value)

    return F.create_map(*[x for key, value in values.items() for x in (F.lit(key), typed(value))])


def telegram_fields(p: Payload) -> dict:
    text, channel = p.get("text"), p.get("channel")
    return dict(
        source_type=F.lit("telegram"), source_name=p.get("channel_name", channel),
        title=F.left(text, F.lit(TITLE_CAP)), content=text,
        url=p.get("url", F.concat(F.lit("https://t.me/"), channel)),
        extra=_extra(views=p.get("views", 0), channel_username=channel),
    )


def rss_fields(p: Payload) -> dict:
    return dict(
        source_type=F.lit("rss"), source_name=p.get("source"), title=p.get("title"),
        content=p.get("summary"), url=p.get("url", p.get("link")), score=p.get("score", 0),
        category=p.get("category"), title_cn=p.optional("title_cn"), content_cn=p.optional("summary_cn"),
    )


def bilibili_fields(p: Payload) -> dict:
    return dict(
        source_type=F.lit("bilibili"), source_name=p.get("author"), title=p.get("title"),
        content=p.get("description"), url=p.get("url"), media_type=F.lit("video"), media_url=p.get("cover"),
        extra=_extra(bvid=p.get("bvid"), duration=p.get("duration", 0), view_count=p.get("view_count", 0)),
    )


def twitter_fields(p: Payload) -> dict:
    text = p.get("text")
    return dict(
        source_type=F.lit("twitter"), source_name=p.get("author"), title=F.left(text, F.lit(TITLE_CAP)),
        content=text, url=p.get("url"), extra=_extra(likes=p.get("likes", 0), retweets=p.get("retweets", 0)),
    )


def wechat_fields(p: Payload) -> dict:
    return dict(
        source_type=F.lit("wechat"), source_name=p.get("author"), title=p.get("title"),
        content=p.get("content"), url=p.get("url"),
    )


def xhs_fields(p: Payload) -> dict:
    pictures = F.size(F.col("images")) > 0 if "images" in p.names else F.lit(False)
    return dict(
        source_type=F.lit("xhs"), source_name=p.get("author"), title=p.get("title"), content=p.get("content"),
        url=p.get("url"), media_type=F.when(pictures, "image").otherwise("text"),
        extra=_extra(likes=p.get("likes", 0), collects=p.get("collects", 0)),
    )


def youtube_fields(p: Payload) -> dict:
    duration = F.col("duration") if "duration" in p.names else F.lit(None).cast("string")
    return dict(
        source_type=F.lit("youtube"), source_name=p.get("author"), title=p.get("title"),
        content=p.get("description"), url=p.get("url"), media_type=F.lit("video"),
        extra=_extra(duration=(duration, ""), view_count=p.get("view_count", 0)),
    )


def manual_fields(p: Payload) -> dict:
    title = p.get("title")
    made = F.concat(F.lit("manual://"), F.left(F.md5(title), F.lit(8)))
    return dict(
        source_type=F.lit("manual"), source_name=F.lit("manual"), title=title,
        content=p.get("content"), url=F.coalesce(present(p.get("url")), made),
    )


def generic_fields(p: Payload) -> dict:
    """Any other page: a manual record named after the authority part as written."""
    url = p.get("url")
    return dict(
        source_type=F.lit("manual"), source_name=urls.authority(url), title=p.get("title"),
        content=p.get("content"), url=url,
    )


CONVERTERS = {
    "telegram": telegram_fields, "rss": rss_fields, "bilibili": bilibili_fields,
    "twitter": twitter_fields, "wechat": wechat_fields, "xhs": xhs_fields,
    "youtube": youtube_fields, "manual": manual_fields, "generic": generic_fields,
}


def convert(df: DataFrame, platform: str, as_of: str, keep: list[str] | None = None) -> DataFrame:
    """Convert payload rows of one platform; ``keep`` columns ride along."""
    return df.select(*(keep or []), *record_columns(as_of, **CONVERTERS[platform](Payload(df))))


def canonical_url(platform: Column, request_url: Column) -> Column:
    """The address a record carries when its payload names none."""
    return (
        F.when(platform == "twitter", urls.tweet_canonical(request_url))
        .when(platform == "bilibili", urls.bv_url(urls.bv_id(request_url)))
        .otherwise(request_url)
    )


ROUTES = ["wechat", "twitter", "youtube", "xhs", "bilibili", "telegram", "rss"]
ROUTED_FIELDS = [
    "source_type", "source_name", "title", "content", "url", "media_type", "media_url", "score", "category",
    "title_cn", "content_cn", "extra",
]


def convert_routed(df: DataFrame, as_of: str, keep: list[str] | None = None) -> DataFrame:
    """Route every landed payload by ``request_url`` and convert it: one scan, no shuffle, no union.

    ``df`` has ``request_url`` and the union of all payload columns. Each record
    field is one CASE over the platform, so a row evaluates only its own branch.
    Platforms without a converter of their own become generic records.
    """
    asked = F.col("request_url")
    routed = df.withColumn("_platform", urls.platform(asked))
    given = F.col("url") if "url" in df.columns else F.lit(None)
    routed = routed.withColumn("url", F.coalesce(given, canonical_url(F.col("_platform"), asked)))
    video = F.when(F.col("_platform") == "bilibili", urls.bv_id(asked))
    routed = routed.withColumn("bvid", F.coalesce(F.col("bvid"), video) if "bvid" in df.columns else video)
    p = Payload(routed)
    branches = {name: CONVERTERS[name](p) for name in [*ROUTES, "generic"]}
    branches["generic"]["source_name"] = urls.authority(asked)
    defaults = {"media_type": F.lit("text"), "score": F.lit(0), "category": F.lit(""),
                "extra": F.create_map().cast("map<string,string>")}

    def field(name: str) -> Column:
        of = lambda platform: branches[platform].get(name, defaults.get(name, F.lit(None)))
        out = F
        for platform in ROUTES:
            out = out.when(F.col("_platform") == platform, of(platform))
        return out.otherwise(of("generic"))

    return routed.select(*(keep or []), *record_columns(as_of, **{name: field(name) for name in ROUTED_FIELDS}))
