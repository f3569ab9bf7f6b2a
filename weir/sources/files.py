"""Text files as rows with exact line numbers, however large the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.text import subtitle_transcript


# A piece of a file starts at a byte offset; offsets count in these units inside line numbers.
OFFSET_UNIT_BITS = 16
PLACE_BITS = 33


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)``; ``line_no`` rises in file order and is unique per file.

    Large files are read in pieces by many tasks, so no file has to pass one
    task. A line number is its piece's offset in 64 KiB units, followed by the
    line's place within the reading task; it has gaps, but it keeps the order.
    """
    lines = spark.read.text(path)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    piece = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), OFFSET_UNIT_BITS), PLACE_BITS)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), (piece + place).alias("line_no"), F.col("value").alias("line")
    )


def subtitle_files(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files ``(name, body)``, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("body")
    )


def subtitle_text(df: DataFrame, body: str = "body", name: str = "transcript") -> DataFrame:
    return df.withColumn(name, subtitle_transcript(F.col(body)))
