"""Queries over archive runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import html
from weir.operators import archive
from weir.plans.landed import VIEWS, spark_sql, view
from weir.plans.registry import query
from weir.plans.texts import SAFE_SQL, TITLE_SQL
from weir.session import fresh_path

PREFIX = "case when index < 1000 then lpad(cast(index as varchar), 3, '0') else cast(index as varchar) end"
VIEWS["v_planned"] = f"""
select list, line_no, index, section, url, case when index % 4 = 0 then 'skip' else 'todo' end as status,
  case when index % 4 <> 0 or title <> '' then title when index % 8 = 0 then 'a-b' else 'old ' || cast(index as string) end as title,
  case when index % 4 = 0 then {PREFIX} || case when index % 8 = 0 then '-a-b.html' else '-old ' || cast(index as string) || '.html' end end as file
from v_entries
"""
VIEWS["v_finished"] = f"""
select list, index, section, url, case when status <> 'ok' then title else full_title end as title,
  case status when 'skip' then file when 'fail' then '' else {PREFIX} || '-' || {SAFE_SQL.format('full_title')} || '.html' end as file, status,
  case when status = 'fail' then case when line_no % 10 = 7 then 'no capture' else 'timeout' end end as error
from (select p.list, p.line_no, p.index, p.section, p.url, p.title, p.file,
    case when p.status = 'skip' then 'skip' when p.line_no % 10 in (7, 9) then 'fail' else 'ok' end as status,
    coalesce(nullif(p.title, ''), nullif(t.title, ''), p.url) as full_title
  from v_planned p join (select page_id, {TITLE_SQL} as title from @pages) t on t.page_id = p.line_no)
"""
VIEWS["v_finished_run"] = f"""
select list, line_no, index, section, url, status, case status when 'skip' then file when 'fail' then '' else {PREFIX} || '-' || {SAFE_SQL.format('full_title')} || '.html' end as file,
  case when status = 'fail' then case line_no % 10 when 7 then 'no capture' when 9 then 'timeout' when 8 then 'no main html part' else 'no snapshot' end end as error
from (select p.list, p.line_no, p.index, p.section, p.url, p.file,
    case when p.status = 'skip' then 'skip' when p.line_no % 10 in (6, 7, 8, 9) then 'fail' else 'ok' end as status,
    coalesce(nullif(p.title, ''), nullif(t.title, ''), p.url) as full_title
  from v_planned p join (select page_id, {TITLE_SQL} as title from @pages) t on t.page_id = p.line_no
  where cast(substr(p.list, 5) as integer) % 3 = 0)
"""


def _entries(spark, sf):
    return archive.parse_url_list(view(spark, sf, "v_urllist"))


LIST = "'list' || cast(cast(floor(page_id / 100) as bigint) as string) as list"


def _existing(spark, sf):
    """An output folder that holds every fourth number, every eighth twice."""
    return spark_sql(spark, sf, f"""
        select list, explode(array('x' || prefix || '-note.html', prefix || '-old ' || n || '.html',
          if(n % 8 = 0, prefix || '-a-b.html', prefix || '-older.txt'))) as file
        from (select {LIST}, page_id % 100 + 1 as n, format_string('%03d', page_id % 100 + 1) as prefix from @pages) where n % 4 = 0""")


def _planned(spark, sf):
    return archive.resume(_entries(spark, sf), _existing(spark, sf))


def _finished(spark, sf):
    captures = spark_sql(spark, sf, f"select {LIST}, page_id as line_no, html from @pages where page_id % 10 <> 7").select(
        "list", "line_no", html.page_title(F.col("html")).alias("page_title"),
        F.when(F.col("line_no") % 10 == 9, "timeout").alias("capture_error"),
    )
    return archive.finish(_planned(spark, sf), captures, on="line_no")


@query("url_list_parse", "select list, line_no, index, section, url, title from v_entries")
def url_list_parse(spark, sf):
    return _entries(spark, sf).select("list", "line_no", "index", "section", "url", "title")


@query("archive_incremental", "select list, index, section, url, title, status, file from v_planned")
def archive_incremental(spark, sf):
    return _planned(spark, sf).select("list", "index", "section", "url", "title", "status", "file")


@query("archive_manifest", """
select list, index, cast(json_object('index', index, 'section', section, 'url', url, 'title', title, 'file', file, 'status', status, 'error', error) as varchar) as json
from v_finished
""")
def archive_manifest(spark, sf):
    return archive.manifest_json(_finished(spark, sf), "list", "index").sort("list", "index")


@query("archive_stats", """
select list, count(*) as n_total, count(*) filter (where status in ('ok', 'skip')) as n_ok, count(*) filter (where status = 'fail') as n_fail
from v_finished group by list
""")
def archive_stats(spark, sf):
    return archive.run_stats(_finished(spark, sf))


def esc_sql(x):
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')")


HEAD_SQL = """
'<!doctype html>' || chr(10) || '<html lang="zh-CN">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10)
|| '<title>归档索引 · ' || cast(n_ok as varchar) || ' 篇</title>' || chr(10) || '<style>' || chr(10)
|| 'body{background:#0b0b0c;color:#e5e7eb;font-family:-apple-system,BlinkMacSystemFont,''Segoe UI'',sans-serif;line-height:1.7;margin:40px auto;max-width:920px;padding:0 20px}'
|| chr(10) || 'a{color:#2dd4bf;text-decoration:none}a:hover{text-decoration:underline}' || chr(10)
|| 'h1{font-size:24px}h2{margin-top:32px;border-top:1px solid #27272a;padding-top:20px;font-size:17px}' || chr(10)
|| 'li{margin:5px 0}.u{color:#71717a;font-size:12px}.fail{color:#f87171}' || chr(10) || '</style>' || chr(10) || '</head>' || chr(10)
|| '<body>' || chr(10) || '<h1>归档索引</h1>' || chr(10) || '<p class="u">成功 ' || cast(n_ok as varchar) || ' · 失败 ' || cast(n_fail as varchar) || ' · 主题 dark</p>'
"""


@query("archive_index", f"""
with first as (select list, section, min(index) as section_pos, max(index) as last from v_finished group by 1, 2)
select e.list, f.section_pos, e.index as line_pos, case when e.status = 'fail' then '<li class="fail">' || {esc_sql("coalesce(nullif(e.title, ''), e.url)")} || ' — 失败</li>'
  else '<li><a href="./' || array_to_string(list_transform(regexp_extract_all(e.file, '(?s).'), lambda c: case when c = '/' then c else url_encode(c) end), '')
    || '">' || {esc_sql("coalesce(nullif(e.title, ''), e.url)")} || '</a></li>' end as html
from v_finished e join first f on f.list = e.list and f.section = e.section
union all select list, section_pos, -1, '<h2>' || {esc_sql('section')} || '</h2>' from first where section <> ''
union all select list, section_pos, 0, '<ol>' from first
union all select list, section_pos, last + 1, '</ol>' from first
union all select list, 0, 0, {HEAD_SQL} from (select list, count(*) filter (where status in ('ok', 'skip')) as n_ok,
  count(*) filter (where status = 'fail') as n_fail from v_finished group by list)
union all select list, max(index) + 1, 0, '</body>' || chr(10) || '</html>' from v_finished group by list
""")
def archive_index(spark, sf):
    """The page is made from the stored run, as the manifest is; its parts read that table, not the whole job again."""
    stored = fresh_path(spark, "run")
    _finished(spark, sf).write.parquet(stored)
    return archive.index_page(spark.read.parquet(stored)).sort("list", "section_pos", "line_pos")


# Of every three lists one holds an address that is refused, and one has no addresses at all.
BARE = "regexp_replace(html, '(?is)<script.*?</script>', ''{g})"


@query("archive_run", f"""
select 'entry' as kind, f.list, f.index, f.file, f.status, case when f.status = 'ok' then length({BARE.format(g=", 'g'")}) end as n_chars, f.error
from v_finished_run f join @pages p on p.page_id = f.line_no
union all select 'run', list, null, null, null, null, case cast(substr(list, 5) as integer) % 3 when 1 then '1 addresses refused' when 2 then 'no URLs found' end
from (select distinct list from v_urllist)
""")
def archive_run(spark, sf):
    """URL lists from their lines to pages, manifest and index; what each run and each entry came to."""
    number = F.substr("list", F.lit(5)).cast("int") % 3
    lines = view(spark, sf, "v_urllist").withColumn("line", F.when((number == 1) & (F.col("line_no") % 100 == 5), "http://x.localhost/")
                                                    .when(number == 2, "# nothing here").otherwise(F.col("line")))
    captures = spark_sql(spark, sf, f"select {LIST}, page_id as line_no, html from @pages where page_id % 10 <> 7").select(
        "list", "line_no", html.page_title(F.col("html")).alias("page_title"), F.when(F.col("line_no") % 10 == 9, "timeout").alias("capture_error"))
    parts = spark_sql(spark, sf, f"""select {LIST}, page_id as line_no, 1 as part_no, 'main' as location, if(page_id % 10 = 8, 'text/plain', 'text/html') as content_type,
        encode({BARE.format(g='')}, 'UTF-8') as data from @pages where page_id % 10 <> 6""")
    path = fresh_path(spark, "archive")
    runs = archive.archive_run(lines, _existing(spark, sf), captures, parts, path, theme=None)
    pages = spark.read.parquet(f"{path}/pages").select("list", "file", F.length("page_html").alias("n_chars"))
    entries = spark.read.parquet(f"{path}/entries").join(pages, ["list", "file"], "left")
    none = lambda kind: F.lit(None).cast(kind)
    return entries.select(F.lit("entry").alias("kind"), "list", "index", "file", "status", "n_chars", "error").unionByName(runs.select(
        F.lit("run").alias("kind"), "list", none("bigint").alias("index"), none("string").alias("file"), none("string").alias("status"),
        none("int").alias("n_chars"), "error"))
