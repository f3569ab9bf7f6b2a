"""Records as JSON and Markdown, link lists, manifests and pages as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.text import markdown_entry
from weir.model import RECORD_FIELDS, extra_text


def record_json() -> Column:
    """One record as a JSON object: nulls kept, open map with its numbers as numbers."""
    typed_extra = F.parse_json(extra_text(F.col("extra"))).alias("extra")
    plain = [F.col(name) for name in RECORD_FIELDS if name != "extra"]
    return F.to_json(F.struct(*plain, typed_extra), {"ignoreNullFields": "false"})


def with_json(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, record_json().alias("json"))


def with_markdown(df: DataFrame, *keep: str) -> DataFrame:
    block = markdown_entry(*(F.col(c) for c in ("title", "source_name", "source_type", "url", "fetched_at", "content")))
    return df.select(*keep, block.alias("block"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON export, one record per line; every part file is valid on its own."""
    with_json(df).write.mode("error").text(path)


def write_json_array(df: DataFrame, path: str, order: str = "seq") -> None:
    """JSON export whose part files, joined in name order, are one array in ``order``.

    Only the lowest order value comes to the driver: it tells which row opens
    the array. The rows are range-sorted and written by many tasks.
    """
    lowest = df.agg(F.min(order).alias("low")).first()["low"]
    mark = F.when(F.col(order) == F.lit(lowest), "[") if lowest is not None else F.lit(None).cast("string")
    body = with_json(df, order).select(
        F.lit(0).alias("_place"), F.col(order).alias("_order"), F.concat(F.coalesce(mark, F.lit(",")), "json").alias("value")
    )
    end = df.sparkSession.range(1).select(
        F.lit(1).alias("_place"), F.lit(None).cast(dict(df.dtypes)[order]).alias("_order"),
        F.lit("]" if lowest is not None else "[]").alias("value"),
    )
    body.unionByName(end).sort("_place", "_order").select("value").write.mode("error").text(path)


def write_markdown(df: DataFrame, path: str, order: str | None = None, mode: str = "append") -> None:
    """Markdown log entries; the writer ends each row with a newline, so the entry's last one is left out."""
    ordered = df if order is None else df.sort(order)
    block = F.regexp_replace("block", r"\n$", "")
    with_markdown(ordered).select(block.alias("value")).write.mode(mode).text(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("error").text(path)


def write_index(page: DataFrame, path: str, run: str = "list") -> None:
    """Index pages below ``path``, one folder per run; the part files in name order make the page.

    Lines are range-partitioned in page order, so one long page is written by many tasks.
    """
    order = [run, "section_pos", "line_pos"]
    ordered = page.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(run, F.col("html").alias("value")).write.mode("error").partitionBy(run).text(path)
