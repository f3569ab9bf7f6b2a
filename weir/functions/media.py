"""Media routing, size limits and digest form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the transcription service and of the segment plan.
UPLOAD_LIMIT_BINARY = 25 * 1024 * 1024
UPLOAD_LIMIT_DECIMAL = 25_000_000
SEGMENT_SECONDS = 600
ROLLING_BUDGET_SECONDS = 7200
VIDEO_SECONDS = 20 * 60
LONG_SECONDS = 2 * 3600


def route(url: Column) -> Column:
    """Which extraction path a media address takes; first match wins."""
    return (
        F.when(url.contains("xiaoyuzhoufm.com/episode/"), "podcast_page")
        .when(url.contains("podcasts.apple.com"), "podcast_download")
        .when(url.contains("bilibili.com") | url.contains("b23.tv"), "video_api")
        .when(url.contains(".mp3") | url.contains(".m4a"), "direct_audio")
        .otherwise("subtitles")
    )


def over_limit(size_bytes: Column, limit: int) -> Column:
    return size_bytes > limit


def segments(duration: Column, size_bytes: Column, limit: int = UPLOAD_LIMIT_DECIMAL) -> Column:
    """array(struct(start_sec, length_sec)): ten-minute cuts above the limit, else one whole piece."""
    count = F.ceil(duration / F.lit(SEGMENT_SECONDS)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
        lambda i: F.struct(
            (i.cast("bigint") * SEGMENT_SECONDS).alias("start_sec"),
            F.least(F.lit(SEGMENT_SECONDS).cast("bigint"), duration - i.cast("bigint") * SEGMENT_SECONDS).alias("length_sec"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start_sec"), duration.cast("bigint").alias("length_sec")))
    return F.when(over_limit(size_bytes, limit) & (count > 0), cut).otherwise(
        F.when(over_limit(size_bytes, limit), F.array().cast("array<struct<start_sec:bigint,length_sec:bigint>>")).otherwise(whole)
    )


def digest_form(duration: Column) -> Column:
    return F.when(duration <= VIDEO_SECONDS, "video").otherwise("podcast")


def needs_confirmation(duration: Column) -> Column:
    return duration > LONG_SECONDS
