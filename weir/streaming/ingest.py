"""The inbox pipeline on Structured Streaming."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.operators import reading
from weir.sinks.exports import write_markdown
from weir.sinks.store import InboxStore


def run_inbox(records: DataFrame, store: InboxStore, markdown_path: str | None, checkpoint: str) -> StreamingQuery:
    """Drain ``records`` (seq + record columns) into the store and the Markdown log.

    Each micro-batch keeps the first record per id, drops ids the store has and
    appends the rest; a replayed batch therefore adds nothing twice. The log
    gets every record, duplicates too, and one folder per batch, so a replay
    rewrites its own entries only.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        held = df.persist()
        try:
            store.add(held)
            if markdown_path:
                write_markdown(held, f"{markdown_path}/batch={batch_id:08d}", mode="overwrite")
        finally:
            held.unpersist()

    return (
        records.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def requests(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Landed requests (``reading.REQUEST_DDL``, parquet) as a stream of about ``max_bytes`` of files per trigger (all that
    have landed, if None), oldest first."""
    stream = spark.readStream.schema(reading.REQUEST_DDL)
    return (stream if max_bytes is None else stream.option("maxBytesPerTrigger", max_bytes)).parquet(path)


def run_reading(asked: DataFrame, as_of: str, store: InboxStore, log: str | None, errors: str, checkpoint: str) -> StreamingQuery:
    """Drain landed requests: guard, route, choose and convert inside the stream, then store, log and error rows.

    A batch is read once and held on disk for its three uses. A replayed batch adds nothing to
    the store and replaces its own part of log and errors.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        held = reading.read(df, as_of).persist(StorageLevel.DISK_ONLY)
        try:
            reading.keep_read(held, store, log, errors, batch_id)
        finally:
            held.unpersist()

    return (
        asked.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def bounded_dedup(records: DataFrame, event_time: str, delay: str = "7 days", key: str = "id") -> DataFrame:
    """De-duplication whose state is dropped once the watermark has passed."""
    return records.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def run_dedup(records: DataFrame, path: str, checkpoint: str, event_time: str = "at", delay: str = "7 days", key: str = "id") -> StreamingQuery:
    """Bounded de-duplication that loses nothing: first keys to ``kept``, rows behind the watermark to ``late``.

    The watermark is the latest event time of earlier batches less ``delay``. A batch is reduced to one row per key first, so a key
    with very many rows is one row a task. Its rows in time are compared with the days of ``kept`` that the watermark has not
    passed, however long the stream runs. Every batch writes folders of its own; done again, it replaces them.
    """
    span = f"interval {delay}"

    def batch(df: DataFrame, number: int) -> None:
        spark, mine = df.sparkSession, f"{number:08d}"
        marks = spark.read.schema("high timestamp, batch string").parquet(f"{path}/marks") if number else spark.createDataFrame([], "high timestamp, batch string")
        high = marks.where(F.col("batch") < mine).agg(F.max("high") - F.expr(span)).first()[0]
        rows = df.groupBy(key).agg(F.min(event_time).alias(event_time)).persist(StorageLevel.DISK_ONLY)
        try:
            in_time = F.col(event_time).isNotNull() & (F.lit(True) if high is None else F.col(event_time) >= F.lit(high))
            fresh = rows.where(in_time).withColumn("day", F.date_format(event_time, "yyyy-MM-dd"))
            if number:
                kept = spark.read.schema(f"{df.select(key, event_time)._jdf.schema().toDDL()}, batch string, day string").parquet(f"{path}/kept")
                open_days = kept.where(F.col("batch") < mine) if high is None else kept.where((F.col("batch") < mine) & (F.col("day") >= f"{high:%Y-%m-%d}"))
                fresh = fresh.join(open_days.select(key), key, "left_anti")
            fresh.write.mode("overwrite").partitionBy("day").parquet(f"{path}/kept/batch={mine}")
            rows.where(~in_time).write.mode("overwrite").parquet(f"{path}/late/batch={mine}")
            rows.agg(F.max(event_time).alias("high")).write.mode("overwrite").parquet(f"{path}/marks/batch={mine}")
        finally:
            rows.unpersist()

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_dedup(spark: SparkSession, path: str, schema: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, late) of ``run_dedup``: every key once, and the late keys that were never kept. Together they are all keys."""
    kept = spark.read.schema(f"{schema}, batch string, day string").parquet(f"{path}/kept").select(key).distinct()
    late = spark.read.schema(f"{schema}, batch string").parquet(f"{path}/late").select(key).distinct()
    return kept, late.join(kept, key, "left_anti")


def daily_source_counts(records: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Records per source and UTC day; a day is emitted when the watermark has passed its end."""
    day = F.date_from_unix_date(F.expr("unix_seconds(_w.start) div 86400").cast("int"))
    return (
        records.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "1 day").alias("_w"), "source_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(day.cast("string").alias("day"), "source_type", "n")
    )


def count_days(records: DataFrame, event_time: str, path: str, checkpoint: str) -> StreamingQuery:
    """Records per source and UTC day of every record, also late ones and days still open.

    Each micro-batch adds its own partial counts in a folder named after it, so a replayed batch
    overwrites itself; ``read_days`` sums them. No state is kept and no row is dropped.
    """
    day = F.date_from_unix_date(F.expr(f"unix_seconds({event_time}) div 86400").cast("int")).cast("string")

    def batch(df: DataFrame, number: int) -> None:
        df.groupBy(day.alias("day"), "source_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """What ``count_days`` has counted so far."""
    parts = spark.read.schema("day string, source_type string, n bigint").parquet(path)
    return parts.groupBy("day", "source_type").agg(F.sum("n").alias("n"))


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a streaming frame over everything available into parquet files."""
    return (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
