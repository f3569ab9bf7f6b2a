"""The routing and identity functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from weir.functions.urls import FEED_MARKS, PLATFORM_HOSTS
from weir.model import ID_LENGTH


def register(spark: SparkSession) -> None:
    """Create temporary SQL functions ``content_id(url)`` and ``detect_platform(url)``.

    They are SQL expressions, so the optimizer sees through them.
    """
    authority = r"lower(regexp_extract(url, r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1))"
    hit = lambda text, marks: " or ".join(f"contains({text}, '{m}')" for m in marks)
    hosts = " ".join(f"when {hit(authority, names)} then '{platform}'" for platform, names in PLATFORM_HOSTS)
    feed = f"endswith(url, '.xml') or {hit('url', FEED_MARKS)}"
    spark.sql(
        f"create or replace temporary function content_id(url string) returns string return left(md5(url), {ID_LENGTH})"
    )
    spark.sql(
        "create or replace temporary function detect_platform(url string) returns string "
        f"return case {hosts} when {feed} then 'rss' else 'generic' end"
    )
