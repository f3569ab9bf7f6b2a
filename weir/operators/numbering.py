"""Positions and carried values inside groups of any size.

A window over a whole group puts the group into one task. Here every group is
cut into blocks of order values; only one summary row per block crosses the
group, and the row-level window runs inside (group, block). The order column is
a whole number that is unique in its group; it may have gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16


KEY = ["_group", "_block"]


def _in_blocks(df: DataFrame, group: list[str], order: str, bits: int) -> DataFrame:
    """Adds the block key; the group goes into a struct so that NULL groups join too."""
    block = F.shiftright(F.col(order).cast("bigint"), bits)
    return df.withColumn("_group", F.struct(*group)).withColumn("_block", block)


def _earlier_blocks():
    return Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def add_ordinal(
    df: DataFrame, group: list[str], order: str, name: str, start: int = 1, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Number the rows ``start``, ``start + 1``, ... per group."""
    cut = _in_blocks(df, group, order, block_bits)
    sizes = cut.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*KEY, F.coalesce(F.sum("_n").over(_earlier_blocks()), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*KEY).orderBy(order)
    return (
        cut.join(offsets, KEY)
        .withColumn(name, (F.row_number().over(within) + F.col("_offset") + (start - 1)).cast("bigint"))
        .drop(*KEY, "_offset")
    )


def carry_and_number(
    df: DataFrame, group: list[str], order: str, *, value: Column, counted: Column, carried: str, index: str,
    default: Column, block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Two running values in one pass over the rows.

    ``carried``: the latest non-NULL ``value`` at or before the row, else
    ``default``. ``index``: how many ``counted`` rows there are up to the row.
    """
    cut = _in_blocks(
        df.withColumn("_value", value).withColumn("_counted", counted), group, order, block_bits
    )
    # One summary per block, count and last value, from one pass over the rows; it is associative, so parts of a block are summed up first.
    blocks = cut.groupBy(*KEY).agg(F.count_if("_counted").alias("_n"), F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    entering = blocks.select(
        *KEY, F.coalesce(F.sum("_n").over(_earlier_blocks()), F.lit(0)).alias("_offset"),
        F.last("_last", ignorenulls=True).over(_earlier_blocks()).alias("_entering"),
    )
    so_far = Window.partitionBy(*KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(entering, KEY)
        .withColumn(carried, F.coalesce(F.last("_value", ignorenulls=True).over(so_far), "_entering", default))
        .withColumn(index, F.count_if("_counted").over(so_far) + F.col("_offset"))
        .drop(*KEY, "_value", "_counted", "_entering", "_offset")
    )
