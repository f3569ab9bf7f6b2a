"""Recent messages per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import urls
from weir.model import iso_timestamp
from weir.operators.inbox import latest

MESSAGE_LIMIT = 20
RECENT_HOURS = 24


def _cutoff(as_of: str, hours: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")


def recent_messages(
    messages: DataFrame, as_of: str, limit: int = MESSAGE_LIMIT, hours: int = RECENT_HOURS, channel: str = "channel"
) -> DataFrame:
    """Newest first, at most ``limit`` messages looked at per channel, up to the first one that is too old.

    The limit counts messages without text as well, so it comes before the
    other tests; it also bounds what each channel brings into the windows.
    """
    seen = latest(messages.withColumn("_ts", F.col("ts").cast("timestamp_ntz")), channel, "msg_id", limit)
    has_text = F.coalesce(F.col("text"), F.lit("")) != ""
    down = Window.partitionBy(channel).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    old = F.max(has_text & (F.col("_ts") < _cutoff(as_of, hours))).over(down)
    return (
        seen.withColumn("_old", old)
        .filter(has_text & ~F.col("_old"))
        .withColumn("views", F.coalesce("views", F.lit(0)))
        .withColumn("date", F.concat(iso_timestamp(F.col("_ts")), F.lit("+00:00")))
        .withColumn("url", urls.telegram_message_url(F.col(channel), F.col("msg_id")))
        .drop("_ts", "_rn", "_old")
    )


def latest_message(messages: DataFrame, as_of: str, hours: int = RECENT_HOURS, channel: str = "channel") -> DataFrame:
    """The single newest message per channel; ``ok`` is false when it has no text or is too old."""
    newest = latest(messages, channel, "msg_id", 1).drop("_rn")
    ok = (F.coalesce(F.col("text"), F.lit("")) != "") & (F.col("ts").cast("timestamp_ntz") >= _cutoff(as_of, hours))
    return newest.withColumn("ok", ok).withColumn("text", F.when(F.col("ok"), F.col("text")))
