"""Archive runs: URL lists, resumption, manifest, index and statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import text, urls
from weir.functions.text import or_empty, present, strip
from weir.operators import snapshot
from weir.operators.guard import preflight
from weir.operators.numbering import carry_and_number
from weir.sinks.exports import write_index

# Manifest layout and the index page's colours and words.
MANIFEST_FIELDS = ["index", "section", "url", "title", "file", "status", "error"]
THEMES = {
    "dark": {"bg": "#0b0b0c", "fg": "#e5e7eb", "accent": "#2dd4bf", "border": "#27272a"},
    "light": {"bg": "#ffffff", "fg": "#1f2328", "accent": "#0f766e", "border": "#e5e7eb"},
}
INDEX_HEAD = """<!doctype html>
<html lang="zh-CN">
<head>
<meta charset="utf-8">
<title>归档索引 · @ok 篇</title>
<style>
body{background:@bg;color:@fg;font-family:-apple-system,BlinkMacSystemFont,'Segoe UI',sans-serif;line-height:1.7;margin:40px auto;max-width:920px;padding:0 20px}
a{color:@accent;text-decoration:none}a:hover{text-decoration:underline}
h1{font-size:24px}h2{margin-top:32px;border-top:1px solid @border;padding-top:20px;font-size:17px}
li{margin:5px 0}.u{color:#71717a;font-size:12px}.fail{color:#f87171}
</style>
</head>
<body>
<h1>归档索引</h1>
<p class="u">成功 @ok · 失败 @fail · 主题 @theme</p>"""
INDEX_TAIL = "</body>\n</html>"


def parse_url_list(lines: DataFrame, run: str = "list", line_no: str = "line_no") -> DataFrame:
    """Lines ``(run, line_no, line)`` to entries ``(run, line_no, index, section, url, title)``.

    A line starting ``##`` sets the section for the lines below it; blank lines,
    ``# `` comments and lines that are no http(s) address are passed over.
    Entries are numbered 1, 2, ... per run in file order.
    """
    # Only headings and addresses matter. The test reads the line as landed, so it runs once,
    # at the scan; a test on the parsed columns would be pushed below and repeat their work.
    wanted = lines.filter(F.col("line").rlike(r"(?U)^[\s\x1c-\x1f]*(?:##|https?://)"))
    bare = wanted.withColumn("_l", strip(F.col("line")))
    heading = F.col("_l").startswith("##")
    cut = F.instr(F.col("_l"), " | ")
    address = F.when(cut > 0, strip(F.left(F.col("_l"), cut - 1))).otherwise(F.col("_l"))
    title = F.when(cut > 0, strip(F.substr(F.col("_l"), cut + 3))).otherwise("")
    kept = bare.select(
        run, line_no,
        F.when(heading, strip(F.ltrim(F.col("_l"), F.lit("#")))).alias("_heading"),
        F.when(~heading, address).alias("url"), title.alias("title"),
    )
    numbered = carry_and_number(
        kept, [run], line_no, value=F.col("_heading"), counted=F.col("_heading").isNull(),
        carried="section", index="index", default=F.lit(""),
    )
    return numbered.filter(F.col("_heading").isNull()).select(run, line_no, "index", "section", "url", "title")


def resume(entries: DataFrame, existing: DataFrame, run: str = "list") -> DataFrame:
    """Marks entries whose numbered file is already there.

    ``existing(run, file)`` lists output names. The lowest matching name wins;
    its title fills an empty one. Adds ``file`` and ``status`` ('skip'/'todo').
    """
    stem = F.regexp_extract("file", r"^([0-9]{3,})-.*\.html$", 1)
    present_files = (
        existing.withColumn("_prefix", stem)
        .filter("_prefix != ''")
        .groupBy(run, "_prefix")
        .agg(F.min("file").alias("_old"))
    )
    prefix = F.format_string("%03d", F.col("index"))
    return (
        entries.withColumn("_prefix", prefix)
        .join(present_files, [run, "_prefix"], "left")
        .withColumn("status", F.when(F.col("_old").isNotNull(), "skip").otherwise("todo"))
        .withColumn("title", F.coalesce(present(F.col("title")), text.title_from_name(F.col("_old")), F.lit("")))
        .withColumnRenamed("_old", "file")
        .drop("_prefix")
    )


def finish(planned: DataFrame, captures: DataFrame, run: str = "list", on: str = "index") -> DataFrame:
    """Resolves 'todo' entries with ``captures(run, on, page_title, capture_error)``.

    Title: custom, else page title, else address. No capture, or one with an
    error, makes a failed entry with an empty file name.
    """
    done = planned.join(captures, [run, on], "left")
    skip = F.col("status") == "skip"
    failed = ~skip & (F.col("page_title").isNull() | F.col("capture_error").isNotNull())
    title = F.coalesce(present(F.col("title")), present(F.col("page_title")), F.col("url"))
    return done.select(
        run, "index", "section", "url",
        F.when(skip | failed, F.col("title")).otherwise(title).alias("title"),
        F.when(skip, F.col("file")).when(failed, "").otherwise(text.numbered_name(F.col("index"), title)).alias("file"),
        F.when(skip, "skip").when(failed, "fail").otherwise("ok").alias("status"),
        F.when(failed, F.coalesce("capture_error", F.lit("no capture"))).alias("error"),
    )


def manifest_json(entries: DataFrame, *keep: str) -> DataFrame:
    """One JSON object per entry with exactly the manifest's keys; missing values are null."""
    body = F.to_json(F.struct(*MANIFEST_FIELDS), {"ignoreNullFields": "false"})
    return entries.select(*keep, body.alias("json"))


def run_stats(entries: DataFrame, run: str = "list") -> DataFrame:
    good = F.col("status").isin("ok", "skip")
    return entries.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(good).alias("n_ok"),
        F.count_if(F.col("status") == "fail").alias("n_fail"),
    )


def index_item(title: Column, url: Column, file: Column, status: Column) -> Column:
    shown = text.escape_html(F.coalesce(present(title), url))
    return F.when(
        status == "fail", F.concat(F.lit('<li class="fail">'), shown, F.lit(" — 失败</li>"))
    ).otherwise(
        F.concat(F.lit('<li><a href="./'), urls.quote_file(or_empty(file)), F.lit('">'), shown, F.lit("</a></li>"))
    )


def index_lines(entries: DataFrame, run: str = "list") -> DataFrame:
    """Body of the index page as ordered lines ``(run, section_pos, line_pos, html)``.

    Sections come in order of first appearance. Lines stay rows: no section is
    ever gathered into one value, and sorting by (section_pos, line_pos) gives
    the page. ``section_pos`` is the section's lowest index; its heading and
    list start sort before it, its list end after every entry.
    """
    first = entries.groupBy(run, "section").agg(
        F.min("index").alias("section_pos"), F.max("index").alias("_last")
    )
    # The keys go into a struct, so that entries without a run or a section join too.
    key = F.struct(run, "section")
    places = first.select(key.alias("_key"), "section_pos")
    items = entries.withColumn("_key", key).join(places, "_key").select(
        run, "section_pos", F.col("index").alias("line_pos"),
        index_item(F.col("title"), F.col("url"), F.col("file"), F.col("status")).alias("html"),
    )
    heading = F.concat(F.lit("<h2>"), text.escape_html(F.col("section")), F.lit("</h2>"))
    frame = F.array(
        F.when(or_empty(F.col("section")) != "", F.struct(F.lit(-1).cast("bigint").alias("line_pos"), heading.alias("html"))),
        F.struct(F.lit(0).cast("bigint").alias("line_pos"), F.lit("<ol>").alias("html")),
        F.struct((F.col("_last") + 1).alias("line_pos"), F.lit("</ol>").alias("html")),
    )
    around = first.select(run, "section_pos", F.inline(F.filter(frame, lambda x: x.isNotNull())))
    return items.unionByName(around)


def index_head(n_ok: Column, n_fail: Column, theme: str = "dark") -> Column:
    """Start of the index page, up to the counts."""
    shade = "dark" if theme == "dark" else "light"
    head = INDEX_HEAD
    for name, colour in THEMES[shade].items():
        head = head.replace(f"@{name}", colour)
    cells = {"@ok": n_ok, "@fail": n_fail, "@theme": F.lit(theme)}
    return F.concat(*[cells[part] if part in cells else F.lit(part) for part in re.split("(@ok|@fail|@theme)", head)])


def index_page(entries: DataFrame, run: str = "list", theme: str = "dark") -> DataFrame:
    """The whole index page as ordered lines: head, sections, tail."""
    counts = run_stats(entries, run)
    head = counts.select(
        run, F.lit(0).cast("bigint").alias("section_pos"), F.lit(0).cast("bigint").alias("line_pos"),
        index_head(F.col("n_ok"), F.col("n_fail"), theme).alias("html"),
    )
    tail = entries.groupBy(run).agg((F.max("index") + 1).alias("section_pos")).select(
        run, "section_pos", F.lit(0).cast("bigint").alias("line_pos"), F.lit(INDEX_TAIL).alias("html")
    )
    return head.unionByName(index_lines(entries, run)).unionByName(tail)


NO_URLS = "no URLs found"


def admitted(lines: DataFrame, entries: DataFrame, run: str = "list", dns: DataFrame | None = None) -> DataFrame:
    """(run, n_urls, error) of every run in ``lines``: a run without addresses, or with one that the guard refuses, does not start."""
    checked = preflight(entries, run, dns).withColumnRenamed(run, "_run")
    refused = F.concat(F.col("n_blocked").cast("string"), F.lit(" addresses refused"))
    return lines.select(run).distinct().join(checked, F.col(run).eqNullSafe(F.col("_run")), "left").select(
        run, F.coalesce("n_urls", F.lit(0)).alias("n_urls"), F.when(F.col("n_urls").isNull(), NO_URLS).when(~F.col("may_run"), refused).alias("error"))


def archive_run(lines: DataFrame, existing: DataFrame, captures: DataFrame, parts: DataFrame, path: str, run: str = "list",
                theme: str | None = "dark", strip_patterns: list[str] | None = None, dns: DataFrame | None = None) -> DataFrame:
    """Archive URL lists: parse, check, resume, make the pages, then index and manifest below ``path``.

    ``lines(run, line_no, line)``, ``existing(run, file)``, ``captures(run, line_no, page_title, capture_error)`` and the
    snapshot ``parts(run, line_no, part_no, location, content_type, data)``. Runs that may not start write nothing. Each step
    is stored once and read by the ones after it: ``runs``, ``pages`` (run, file, page_html), ``entries``, ``manifest`` and ``index``.
    Returns one row per run: n_urls, n_ok, n_fail, error.
    """
    spark = lines.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    parsed = stored(parse_url_list(lines, run), "parsed")
    runs = stored(admitted(lines, parsed, run, dns), "runs")
    entries = parsed.join(runs.filter("error is null").select(run), run, "left_semi")
    planned = stored(resume(entries, existing, run), "planned")
    # Parts of entries that are there already, or of other runs, are never put together.
    todo = planned.filter("status = 'todo'").select(run, "line_no")
    wanted = parts.join(todo, [run, "line_no"], "left_semi").withColumn("_page", F.struct(run, "line_no"))
    pages = stored(snapshot.inline(snapshot.gather_parts(wanted.drop(run, "line_no"), "_page"), theme, strip_patterns).select(
        F.col("_page")[run].alias(run), F.col("_page")["line_no"].alias("line_no"), "page_html", F.col("error").alias("part_error")), "made")
    taken = captures.join(pages.select(run, "line_no", "part_error", F.lit(True).alias("_made")), [run, "line_no"], "left")
    error = F.coalesce("capture_error", "part_error", F.when(F.col("_made").isNull(), "no snapshot"))
    done = finish(planned, taken.select(run, "line_no", "page_title", error.alias("capture_error")), run, on="line_no")
    numbers = planned.select(run, "line_no", "index")
    done = stored(done.join(numbers, [run, "index"]), "entries")
    named = done.filter("status = 'ok'").select(run, "line_no", "file")
    pages.join(named, [run, "line_no"]).select(run, "file", "page_html").write.parquet(f"{path}/pages")
    manifest_json(done, run, "index").write.partitionBy(run).json(f"{path}/manifest")
    write_index(index_page(done, run, theme or "dark"), f"{path}/index", run)
    return runs.join(run_stats(done, run), run, "left").select(run, "n_urls", "n_ok", "n_fail", "error")
