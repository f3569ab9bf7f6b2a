"""Link harvesting and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import html
from weir.operators.inbox import first_wins


def harvest(pages: DataFrame, page: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``(page, pos, href, text)``: same-origin links of every page, first per target, in document order.

    Done inside each page's row; nothing is shuffled.
    """
    links = pages.select(page, F.explode(html.same_origin_links(F.col(url), F.col(body))).alias("_l"))
    return links.select(page, F.col("_l.pos").alias("pos"), F.col("_l.href").alias("href"), F.col("_l.text").alias("text"))


def merge(*lists: DataFrame, order: list[str]) -> DataFrame:
    """Several link lists as one; the first mention of each target stays.

    ``order`` must rank rows over all lists (for example list number, page, position).
    """
    return first_wins(reduce(DataFrame.unionByName, lists), "href", order)


def link_line(href: Column, text: Column) -> Column:
    return F.concat(href, F.lit(" | "), text)
