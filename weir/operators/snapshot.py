"""Page snapshots: from parts to one self-contained page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import html
from weir.functions.text import let


def _last_per_location(parts: Column) -> Column:
    """One entry per location: the place of the first, the content of the last.

    Sorting by location brings the entries of one location together, so no part is compared
    with every other; it runs only when a hash-based count shows that a location repeats.
    """
    repeats = lambda ps: F.size(F.array_distinct(ps["location"])) < F.size(ps)
    differs = lambda a, b: a["location"].isNull() | (a["location"] != b["location"])

    def merged(ps: Column) -> Column:
        ordered = F.array_sort(F.transform(ps, lambda p, i: F.struct(p["location"].alias("location"), i.alias("at"))))

        def ends(xs: Column) -> Column:
            firsts = F.filter(xs, lambda x, i: (i == 0) | differs(F.get(xs, i - 1), x))
            lasts = F.filter(xs, lambda x, i: differs(F.get(xs, i + 1), x))
            return F.array_sort(F.zip_with(firsts, lasts, lambda f, l: F.struct(f["at"].alias("first"), l["at"].alias("last"))))

        return F.transform(let(ordered, ends), lambda r: F.get(ps, r["last"]))

    return let(parts, lambda ps: F.when(repeats(ps), merged(ps)).otherwise(ps))


def gather_parts(parts: DataFrame, page: str = "page_id") -> DataFrame:
    """Parts ``(page, part_no, location, content_type, data)`` to one row per page.

    The first html part is ``main``; css parts and all others become arrays in
    part order, one entry per location. Pages without an html part have
    ``main`` NULL and ``error`` set. Parts without data are passed over; a missing
    location or content type counts as none given. The parts move through one shuffle; a
    group is one snapshot file.
    """
    one = F.struct("part_no", F.coalesce("location", F.lit("")).alias("location"), "content_type", "data")
    filled = F.collect_list(F.when(F.col("data").isNotNull(), one))
    rows = parts.groupBy(page).agg(F.array_sort(filled).alias("_parts"))
    first_html = F.get(F.filter("_parts", lambda p: p["content_type"] == "text/html"), F.lit(0))
    rows = rows.withColumn("_main", first_html)
    css = F.filter("_parts", lambda p: p["content_type"] == "text/css")
    others = F.filter(
        "_parts",
        lambda p: ~p["content_type"].eqNullSafe("text/css") & ~p["part_no"].eqNullSafe(F.col("_main.part_no")),
    )
    utf8 = lambda data: F.decode(data, "UTF-8")
    return rows.select(
        page,
        utf8(F.col("_main.data")).alias("main"),
        F.transform(
            _last_per_location(css), lambda p: F.struct(p["location"].alias("location"), utf8(p["data"]).alias("css"))
        ).alias("css"),
        F.transform(
            _last_per_location(others),
            lambda p: F.struct(
                p["location"].alias("location"), html.data_uri(p["content_type"], p["data"]).alias("uri")
            ),
        ).alias("resources"),
        F.when(F.col("_main").isNull(), "no main html part").alias("error"),
    )


def inline(gathered: DataFrame, theme: str | None = "dark", strip_patterns: list[str] | None = None) -> DataFrame:
    """Adds ``page_html``: scripts out, styles and resources in, caller removals, theme."""
    styled = F.aggregate(
        F.filter("css", lambda c: c["location"] != ""),
        html.strip_scripts(F.col("main")),
        lambda h, c: html.inline_style(h, c["location"], html.replace_all(c["css"], F.col("resources"))),
    )
    whole = html.replace_all(styled, F.col("resources"))
    done = html.rewrite_theme(html.strip_patterns(whole, strip_patterns or []), theme)
    return gathered.withColumn("page_html", done)
