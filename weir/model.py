"""The unified record: schema, enumerations, defaults and text form.

The values of the open map ``extra`` are JSON texts (see ``json_value``), so they keep their types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The enumerations and the record layout every store and sink shares.
SOURCE_TYPES = ["telegram", "rss", "bilibili", "xhs", "twitter", "wechat", "youtube", "manual"]
MEDIA_TYPES = ["text", "video", "audio", "image"]
PRIORITIES = ["hot", "quality", "deep", "normal", "low"]
RECORD_DDL = (
    "source_type string, source_name string, title string, content string, url string, "
    "id string, fetched_at string, media_type string, media_url string, score int, "
    "priority string, category string, tags array<string>, processed boolean, "
    "digest_date string, title_cn string, content_cn string, extra map<string,string>"
)
RECORD_FIELDS = [part.split()[0] for part in RECORD_DDL.split(", ")]
REQUIRED_FIELDS = ["source_type", "source_name", "title", "content", "url"]
ID_LENGTH = 12


def content_id(url: Column, given: Column | None = None) -> Column:
    """First 12 hex digits of md5(url); an id already present is kept."""
    derived = F.left(F.md5(url), F.lit(ID_LENGTH))
    return derived if given is None else F.coalesce(F.nullif(given, F.lit("")), derived)


def iso_timestamp(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS`` with six decimals only when the fraction is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(exact.endswith(".000000"), whole).otherwise(exact)


def record_columns(as_of: str, **fields: Column) -> list[Column]:
    """The record's columns in order; fields left out take the record's defaults."""
    text = lambda name: fields.get(name, F.lit("")).cast("string")
    maybe = lambda name: fields.get(name, F.lit(None)).cast("string")
    columns = {
        "source_type": text("source_type"),
        "source_name": text("source_name"),
        "title": text("title"),
        "content": text("content"),
        "url": text("url"),
        "id": content_id(text("url"), text("id")),
        "fetched_at": F.coalesce(F.nullif(maybe("fetched_at"), F.lit("")), F.lit(as_of)),
        "media_type": fields.get("media_type", F.lit("text")),
        "media_url": maybe("media_url"),
        "score": fields.get("score", F.lit(0)).cast("int"),
        "priority": fields.get("priority", F.lit("normal")),
        "category": text("category"),
        "tags": fields.get("tags", F.array().cast("array<string>")),
        "processed": fields.get("processed", F.lit(False)),
        "digest_date": maybe("digest_date"),
        "title_cn": maybe("title_cn"),
        "content_cn": maybe("content_cn"),
        "extra": fields.get("extra", F.create_map().cast("map<string,string>")),
    }
    return [columns[name].alias(name) for name in RECORD_FIELDS]


def json_value(value: Column) -> Column:
    """A value as JSON text of its own type: text quoted, numbers and booleans plain, lists and objects whole, NULL as null."""
    return F.regexp_replace(F.to_json(F.array(value), {"ignoreNullFields": "false"}), r"(?s)^\[|\]$", "")


def extra_text(extra: Column) -> Column:
    """The open map as JSON text. Its values are JSON texts already, so every type is written as it was read."""
    key = lambda e: F.regexp_replace(F.to_json(F.array(e["key"])), r"(?s)^\[|\]$", "")
    pair = lambda e: F.concat(key(e), F.lit(":"), F.coalesce(e["value"], F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(extra), pair), ","), F.lit("}"))


def flat(df: DataFrame, *keep: str) -> DataFrame:
    """Record columns with the list and the map as text, plus any ``keep`` columns."""
    plain = [name for name in RECORD_FIELDS if name not in ("tags", "extra")]
    return df.select(
        *keep, *plain, F.array_join("tags", ",").alias("tags"), extra_text(F.col("extra")).alias("extra")
    )
