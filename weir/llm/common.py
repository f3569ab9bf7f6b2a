"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.session import fresh_path

#: White space between words, and the characters it is made of.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Tasks that even a small result is written by.
FEWEST = 8


def words(text: Column) -> Column:
    """Words of a text (runs of anything but white space); NULL and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS[1:]:  # plain replacements and a one-character split are far cheaper than a pattern
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df``, of at most ``rows`` rows, with a last step that takes a task for ``each`` of them, and ``FEWEST`` at least, instead of as
    many tasks as a shuffle has partitions, however little is in them."""
    return df.coalesce(max(FEWEST, parts(rows, each)))


def fraction(value: str | Column, buckets: int = 1 << 40) -> Column:
    """A pseudo-random whole number below ``buckets``, the same on every engine with MD5."""
    digest = F.md5((F.col(value) if isinstance(value, str) else value).cast("string"))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("long") % F.lit(buckets)


def parts(rows: int, each: int) -> int:
    """How many parts of about ``each`` rows; at least one."""
    return max(1, math.ceil(rows / each))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
