"""First-wins de-duplication, membership, state changes and retention of the inbox."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.functions.text import listing_line, present


def first_wins(df: DataFrame, key: list[str] | str = "id", order: list | str = "seq") -> DataFrame:
    """The row seen first per key.

    ``row_number() = 1`` becomes a group limit that already runs before the
    shuffle, so a key with very many copies sends one row per map task.
    """
    keys = [key] if isinstance(key, str) else key
    orders = [order] if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(*orders)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: Ranks up to this are cut before the shuffle by the optimizer itself (its default).
EARLY_LIMIT = 1000
SALTS = 64


def latest(df: DataFrame, key: list[str] | str, order: str, limit: int = 1) -> DataFrame:
    """The ``limit`` newest rows per key, with their rank in ``_rn``; also limited before the shuffle.

    A larger limit takes two steps: first the newest of each of SALTS parts of a key, then those of the key.
    The last step gets SALTS times the limit at most, so a key with very many rows never meets in one task.
    """
    keys = [key] if isinstance(key, str) else key
    newest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))
    if limit > EARLY_LIMIT:
        parts = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(SALTS)))
        df = parts.withColumn("_rn", newest(*keys, "_salt")).filter(F.col("_rn") <= limit).drop("_salt", "_rn")
    return df.withColumn("_rn", newest(*keys)).filter(F.col("_rn") <= limit)


def known_ids(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Ids of ``batch`` that the store already holds.

    The store is read for its id column only and cut down by the batch's ids
    first; the optimizer broadcasts those ids when they measure small.
    """
    return store.select("id").join(batch.select("id").distinct(), "id", "left_semi").distinct()


def _winners(slim: DataFrame, store: DataFrame, order: str) -> DataFrame:
    """(id, order) of the rows that an insert would accept: first per id and not in the store. A hash aggregate, no id gathers."""
    return slim.groupBy("id").agg(F.min(order).alias(order)).join(known_ids(slim, store), "id", "left_anti")


def new_records(batch: DataFrame, store: DataFrame, order: str = "seq") -> DataFrame:
    """Records to append: first per id in the batch and not in the store.

    Decided on (``order``, id), the arrival number being unique; the content meets the accepted rows only.
    """
    accepted = _winners(batch.select(order, "id"), store, order)
    return batch.join(accepted, [order, "id"], "left_semi")


def added_flags(batch: DataFrame, store: DataFrame, order: str = "seq") -> DataFrame:
    """Every batch row's (order, id) with ``added``: true when the insert would be accepted.

    The winners are found by a hash aggregate and matched back on the unique
    arrival number, so a hot id never gathers in one task.
    """
    slim = batch.select(order, "id")
    flags = _winners(slim, store, order).select(order, F.lit(True).alias("added"))
    return slim.join(flags, order, "left").withColumn("added", F.coalesce("added", F.lit(False)))


def unprocessed(store: DataFrame) -> DataFrame:
    return store.filter(~F.col("processed"))


def by_source(store: DataFrame, source_type: str) -> DataFrame:
    return store.filter(F.col("source_type") == source_type)


def last_marks(updates: DataFrame) -> DataFrame:
    """(id, digest_date) of (id, digest_date, update_seq) updates: the last date given to an id, NULL if none was."""
    date = present(F.col("digest_date"))
    return updates.groupBy("id").agg(F.max(F.when(date.isNotNull(), F.struct("update_seq", "digest_date")))["digest_date"].alias("digest_date"))


def mark_processed(store: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (id, digest_date, update_seq) updates: processed becomes true, the last given date stays."""
    per_id = last_marks(updates).withColumnRenamed("digest_date", "_date").withColumn("_hit", F.lit(True))
    return (
        store.join(per_id, "id", "left")
        .withColumn("processed", F.col("processed") | F.coalesce("_hit", F.lit(False)))
        .withColumn("digest_date", F.coalesce("_date", "digest_date"))
        .drop("_hit", "_date")
    )


def cutoff(as_of: str, days: int) -> str:
    return (datetime.fromisoformat(as_of) - timedelta(days=days)).isoformat()


def keep_recent(store: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Retention by text comparison of ISO stamps; a stamp equal to the cutoff goes."""
    return store.filter(F.col("fetched_at") > F.lit(cutoff(as_of, days)))


def last_added(df: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(limit)


def numbered_tail(df: DataFrame, limit: int, order: str = "seq", name: str = "position") -> DataFrame:
    """The last ``limit`` rows numbered from 1; the window sees only those rows."""
    return last_added(df, limit, order).withColumn(name, F.row_number().over(Window.orderBy(order)))


def listing(store: DataFrame, limit: int = 20, order: str = "seq") -> DataFrame:
    """``(position, line)``: a headline with the inbox size at 0, then the last ``limit`` items."""
    n = F.count(F.lit(1))
    headline = F.when(n == 0, "📦 Inbox is empty").otherwise(F.concat(F.lit("📦 Inbox: "), n, F.lit(" items")))
    line = listing_line(F.col("position"), F.col("source_type"), F.col("title"))
    items = numbered_tail(store, limit, order).select("position", line.alias("line"))
    return store.agg(headline.alias("line")).select(F.lit(0).alias("position"), "line").unionByName(items)


def source_counts(df: DataFrame, key: str = "source_name") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
