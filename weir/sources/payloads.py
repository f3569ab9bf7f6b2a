"""Platform payloads landed as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions import urls
from weir.functions.text import or_empty, strip_tags

VIDEO_SCHEMA = (
    "code int, message string, data struct<title:string,`desc`:string,owner:struct<name:string>,"
    "pic:string,duration:int,stat:struct<view:int>>"
)
POST_SCHEMA = "tweet struct<text:string,author:struct<name:string,screen_name:string>>"
EMBED_SCHEMA = "html string, author_name string, author_url string"


def video_payloads(df: DataFrame, url: str = "url", payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Video service answers: fields with defaults, or ``error`` when the service refused."""
    p = df.withColumn("_p", F.from_json(payload, VIDEO_SCHEMA)).withColumn("_bv", urls.bv_id(F.col(url)))
    d = F.col("_p.data")
    refused = ~F.col("_p.code").eqNullSafe(F.lit(0))
    error = (
        F.when(F.col("_bv") == "", F.concat(F.lit("no video id in "), F.col(url)))
        .when(refused, F.concat(F.lit("service error: "), or_empty(F.col("_p.message"))))
        .when(d.isNull(), "no data")
    )
    return p.withColumn("error", error).select(
        *(keep or []), "error",
        or_empty(d["title"]).alias("title"), or_empty(d["desc"]).alias("description"),
        or_empty(d["owner"]["name"]).alias("author"), urls.bv_url(F.col("_bv")).alias("url"),
        or_empty(d["pic"]).alias("cover"), F.col("_bv").alias("bvid"),
        F.coalesce(d["duration"], F.lit(0)).alias("duration"),
        F.coalesce(d["stat"]["view"], F.lit(0)).alias("view_count"),
    )


def post_payloads(df: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Post API answers: text, @screen name, name and capped title."""
    t = F.from_json(payload, POST_SCHEMA)["tweet"]
    p = df.select(
        *(keep or []), or_empty(t["text"]).alias("text"),
        or_empty(t["author"]["name"]).alias("author_name"), or_empty(t["author"]["screen_name"]).alias("_screen"),
    )
    handle = F.when(F.col("_screen") != "", F.concat(F.lit("@"), F.col("_screen"))).otherwise("")
    return p.select(*(keep or []), "text", handle.alias("author"), "author_name", F.left("text", F.lit(100)).alias("title"))


def embed_payloads(df: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Embed cards: the card's HTML without tags, author name and address."""
    p = df.withColumn("_e", F.from_json(payload, EMBED_SCHEMA))
    p = p.withColumn("text", strip_tags(or_empty(F.col("_e.html"))))
    return p.select(
        *(keep or []), "text", or_empty(F.col("_e.author_name")).alias("author"),
        or_empty(F.col("_e.author_url")).alias("author_url"), F.left("text", F.lit(100)).alias("title"),
    )


def join_results(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with their outcome: every request stays, in ``ok`` and ``error`` form.

    ``results(keys..., title, content, error)``; a request without a result failed.
    """
    joined = requests.join(results, keys, "left")
    error = F.coalesce("error", F.when(F.col("title").isNull(), "no result"))
    return joined.withColumn("error", error).withColumn("ok", F.col("error").isNull())


