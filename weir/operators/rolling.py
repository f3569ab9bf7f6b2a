"""Rolling sums over time for keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_sum(
    df: DataFrame, key: str, ts: str, value: str, name: str, window_seconds: int, step_seconds: int = 60
) -> DataFrame:
    """Sum of ``value`` over ``[ts - window, ts]`` per key, both ends included.

    The window is split into steps. A row's sum is: its own step up to itself,
    the whole steps in between (one pre-aggregated row per key and step), and
    the part of the oldest step that is still inside. For that last part each
    row also appears once, moved forward by the window, as context. No task
    sees more than one key's rows of two steps.
    """
    if window_seconds % step_seconds:
        raise ValueError("window_seconds must be a multiple of step_seconds")
    width, step = window_seconds * 1_000_000, step_seconds * 1_000_000
    span = window_seconds // step_seconds
    since = "timestamp_ntz'1970-01-01 00:00:00'"
    micros = F.expr(f"timestampdiff(MICROSECOND, {since}, cast({ts} as timestamp_ntz))")
    step_of_row = F.expr(f"_t div {step}")
    # The key goes into a struct so that rows without a key join as well.
    base = df.withColumn("_key", F.struct(key)).withColumn("_t", micros)
    per_step = base.groupBy("_key", step_of_row.alias("_step")).agg(F.sum(value).alias("_s"))
    # Each step's total is due in the steps 1 .. span-1 after it: a running sum over step numbers.
    between = Window.partitionBy("_key").orderBy("_step").rangeBetween(-(span - 1), -1)
    middle = per_step.select("_key", "_step", F.coalesce(F.sum("_s").over(between), F.lit(0)).alias("_middle"))
    own = base.withColumn("_own", F.lit(True))
    context = base.select(
        *[(F.col(c) if c == value else F.lit(None).cast(t)).alias(c) for c, t in df.dtypes],
        "_key", (F.col("_t") + width).alias("_t"), F.lit(False).alias("_own"),
    )
    both = own.unionByName(context).withColumn("_step", step_of_row)
    w = Window.partitionBy("_key", "_step").orderBy("_t")
    up_to = w.rangeBetween(Window.unboundedPreceding, 0)
    onwards = w.rangeBetween(0, Window.unboundedFollowing)
    mine = F.sum(F.when(F.col("_own"), F.col(value))).over(up_to)
    oldest = F.sum(F.when(~F.col("_own"), F.col(value))).over(onwards)
    total = F.coalesce(mine, F.lit(0)) + F.col("_middle") + F.coalesce(oldest, F.lit(0))
    joined = both.join(middle, ["_key", "_step"]).withColumn(name, total)
    return joined.filter("_own").drop("_key", "_t", "_own", "_step", "_middle")
