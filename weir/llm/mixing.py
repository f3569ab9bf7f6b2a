"""Mixing sources to target weights by temperature. Native: DataFrame functions only.

A source with a share p of all tokens gets the weight p**a / sum(p**a). The exponent a between 0
(even weights) and 1 (natural weights) is bisected: entropy falls and repetition shrinks as it
grows. The weights times the budget are the sources' token budgets. Each source passes over its
documents as often as its budget allows; the last, partial pass takes a prefix of a permutation
of its blocks, and within a block of its documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.llm.common import fraction, words, written

#: Halvings of the exponent's interval that one pass over the source table decides.
STEPS = 4


def _measures(a: float) -> list[Column]:
    """sum p**a and sum p**a ln p."""
    e = F.pow("p", F.lit(a))
    return [F.sum(e), F.sum(e * F.log("p"))]


def exponent(sources: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None,
             budget: float | None = None, passes: int = 8) -> float:
    """The exponent for a table of sources with their shares ``p`` (above 0, sum 1).

    The smallest exponent with at most ``target_entropy`` (a part of the largest possible entropy)
    and at most ``max_repeat`` passes over any source. ``budget`` is in units of all tokens; None
    stands for the smallest budget that uses every document at least once. The interval is halved
    ``STEPS * passes`` times; each pass is one aggregation of all candidate exponents.
    """
    n, low_p, high_p = sources.agg(F.count("*"), F.min("p"), F.max("p")).first()
    if not n or n == 1:
        return 1.0

    def too_small(a: float, z: float, zl: float) -> bool:
        entropy = math.log(z) - a * zl / z
        total = budget if budget is not None else z * high_p ** (1 - a)
        repeat = total * low_p ** (a - 1) / z
        return (target_entropy is not None and entropy > target_entropy * math.log(n)) or (max_repeat is not None and repeat > max_repeat)

    low, high = 0.0, 1.0
    for _ in range(passes):
        grid = [low + (high - low) * i / (1 << STEPS) for i in range(1 << STEPS)]
        values = sources.agg(*[c for a in grid for c in _measures(a)]).first()
        found = {i: too_small(a, values[2 * i], values[2 * i + 1]) for i, a in enumerate(grid)}
        if low == 0.0 and not found[0]:
            return 0.0
        left, right = 0, 1 << STEPS  # bisection among the exponents measured in this pass
        while right - left > 1:
            mid = (left + right) // 2
            left, right = (mid, right) if found[mid] else (left, mid)
        width = (high - low) / (1 << STEPS)
        low, high = low + width * left, low + width * right
    return high


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float | None = 0.97,
        max_repeat: float | None = 4.0, budget: float | None = 1.0, block_docs: int = 2000, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, n_tokens, source_tokens, source_budget, block,
    before (tokens ahead of it in its source's permutation), copies.

    Tokens are words. Documents without any (NULL, empty) take no budget: they share the copies of
    the full passes. A NULL source is a source of its own. Rows that repeat an id stand next to each other.
    A document is in the partial pass if it ends within the rest of the budget. With ``budget``
    None every document is used at least once. Only the three named columns are read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.size(words(F.col(text))).cast("long").alias("n_tokens"))
    per_source = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("n")), "sources")
    total = per_source.agg(F.sum("source_tokens")).first()[0] or 0
    shares = per_source.where("source_tokens > 0").withColumn("p", F.col("source_tokens") / F.lit(float(total or 1)))
    a = round(exponent(shares, target_entropy, max_repeat, budget), 6)
    z, high = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max("p")).first()
    tokens = (budget if budget is not None else (z or 0) * (high or 0) ** (1 - a)) * total
    p = F.col("source_tokens") / F.lit(float(total or 1))
    wanted = F.round(F.pow(p, F.lit(a)) / F.lit(z or 1.0) * F.lit(float(tokens))).cast("long")
    if budget is None:
        wanted = F.greatest(wanted, F.col("source_tokens"))
    plan = per_source.select(F.col("source").alias("s"), "source_tokens", F.ceil(F.col("n") / block_docs).alias("blocks"),
                             F.when(F.col("source_tokens") > 0, wanted).otherwise(0).alias("source_budget"))
    # Both windows are small: the blocks of a source, and the documents of a block.
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", fraction(F.concat_ws(":", F.lit(seed), F.lit("b"), "doc_id")) % F.col("blocks"))
    sums = placed.groupBy("s", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    order = Window.partitionBy("s").orderBy(fraction(F.concat_ws(":", F.lit(seed), F.lit("o"), "s", "block")), "block")
    sums = sums.select(F.col("s").alias("bs"), F.col("block").alias("bb"), (F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")).alias("ahead"))
    inner = Window.partitionBy("s", "block").orderBy(fraction(F.concat_ws(":", F.lit(seed), F.lit("d"), "doc_id")), "doc_id")
    inside = F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("inside", inside).join(sums, F.col("s").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")))
    end = F.col("ahead") + F.col("inside")
    full = F.when(F.col("source_tokens") > 0, F.expr("source_budget div source_tokens")).otherwise(1)
    rest = F.when(F.col("source_tokens") > 0, F.expr("source_budget % source_tokens")).otherwise(0)
    return out.select("doc_id", "source", "n_tokens", "source_tokens", "source_budget", "block", (end - F.col("n_tokens")).cast("long").alias("before"),
                      (full + F.when((F.col("n_tokens") > 0) & (end <= rest), 1).otherwise(0)).cast("long").alias("copies"))
