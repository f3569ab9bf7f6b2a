"""Queries over text, HTML and subtitles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import html, text
from weir.functions.text import or_empty
from weir.operators import snapshot, transcripts
from weir.plans.landed import VIEWS, spark_sql, view
from weir.plans.registry import query
from weir.sources.payloads import embed_payloads

BLOCKS = "p|div|li|ul|ol|h[1-6]|nav|section|article|main|header|footer|table|tr|blockquote|pre"


def decode_sql(x: str) -> str:
    # The references that the pages hold; the ampersand last.
    for sign, shown in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&amp;", "&")):
        x = f"replace({x}, '{sign}', '{shown}')"
    return x


def clean_sql(x: str) -> str:
    return (rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), "
            r"'(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g')")


def inner_sql(x: str) -> str:
    lines = rf"regexp_replace({x}, '(?i)<br\s*/?>|</?(?:{BLOCKS})\b[^>]*>', chr(10), 'g')"
    plain = decode_sql(f"regexp_replace({lines}, '<[^>]+>', '', 'g')")
    spaced = rf"regexp_replace({plain}, '[ \t\r\f]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({spaced}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


TITLE_SQL = "substr(trim({}, chr(9) || chr(10) || chr(13) || ' '), 1, 200)".format(
    decode_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
)
ARTICLE_SQL = inner_sql(rf"regexp_extract({clean_sql('html')}, '(?is)<article(?:\s[^>]*)?>(.*?)</article\s*>', 1)")
BODY_SQL = inner_sql(rf"regexp_extract({clean_sql('html')}, '(?is)<body(?:\s[^>]*)?>(.*?)(?:</body\s*>|\z)', 1)")
VIEWS["v_page_text"] = f"select page_id, url, {TITLE_SQL} as title, {ARTICLE_SQL} as content from @pages"
TRIM = "trim({}, chr(9) || chr(10) || chr(13) || ' ')"


@query("oembed_text", rf"""
select doc_id, substr(t, 1, 100) as title, t as text, 'n' || cast(doc_id as varchar) as author, 'https://x.com/n' || cast(doc_id as varchar) as author_url
from (select doc_id, trim(regexp_replace(regexp_replace('<blockquote><p lang="en">' || text || '</p>&mdash; N</blockquote>', '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as t from @documents)
""")
def oembed_text(spark, sf):
    cards = spark_sql(spark, sf, """
        select doc_id, to_json(named_struct('html', '<blockquote><p lang="en">' || text || '</p>&mdash; N</blockquote>',
          'author_name', 'n' || cast(doc_id as string), 'author_url', 'https://x.com/n' || cast(doc_id as string))) as payload
        from @documents""")
    return embed_payloads(cards, keep=["doc_id"])


@query("markdown_split", f"""
select doc_id, 'Title ' || cast(doc_id as varchar) as title, {TRIM.format('text')} as content from @documents
""")
def markdown_split(spark, sf):
    parts = view(spark, sf, "v_markdown").select("doc_id", text.markdown_parts(F.col("body")).alias("p"))
    return parts.select("doc_id", "p.title", "p.content")


VIEWS["v_doc_lines"] = """
select doc_id, pos, trim(line, chr(9) || chr(13) || ' ') as line from (select doc_id, unnest(l) as line, unnest(generate_series(1, len(l))) as pos
  from (select doc_id, string_split(body, chr(10)) as l from v_srt))
"""
SPOKEN = r"line <> '' and not regexp_matches(line, '^\d+$') and not contains(line, '-->') and not (starts_with(line, '[') and ends_with(line, ']'))"
VIEWS["v_transcript"] = f"""
select d.doc_id, coalesce(t.transcript, '') as transcript from @documents d left join (
  select doc_id, string_agg(line, ' ' order by pos) as transcript from (
    select doc_id, line, min(pos) as pos from v_doc_lines where {SPOKEN} group by doc_id, line) group by doc_id) t on t.doc_id = d.doc_id
"""


def _transcripts(spark, sf):
    return view(spark, sf, "v_srt").select("doc_id", text.subtitle_transcript(F.col("body")).alias("transcript"))


@query("srt_transcript", "select doc_id, transcript from v_transcript")
def srt_transcript(spark, sf):
    return _transcripts(spark, sf)


@query("transcript_stats", "select doc_id, length(transcript) as n_chars, transcript <> '' as has_transcript from v_transcript")
def transcript_stats(spark, sf):
    return transcripts.stats(_transcripts(spark, sf), "doc_id", F.col("transcript"))


@query("srt_distinct_lines", f"""
select conv_id, turn, pos, line from (select *, row_number() over (partition by conv_id, line order by turn, pos) as rn
  from (select conv_id, turn, pos, trim(line, chr(9) || chr(13) || ' ') as line from (
    select conv_id, turn, unnest(l) as line, unnest(generate_series(0, len(l) - 1)) as pos
    from (select conv_id, turn, string_split(cue, chr(10)) as l from v_cues))) where {SPOKEN}) where rn = 1
""")
def srt_distinct_lines(spark, sf):
    lines = view(spark, sf, "v_cues").select("conv_id", "turn", F.posexplode(F.split("cue", r"\r\n|\r|\n")).alias("pos", "line"))
    return transcripts.distinct_lines(lines, "conv_id", ["turn", "pos"])


@query("transcript_concat", """
select conv_id, string_agg(text, chr(10) order by turn, text) as transcript from @conversations group by 1
""")
def transcript_concat(spark, sf):
    turns = spark_sql(spark, sf, "select conv_id, turn, text from @conversations")
    return transcripts.concat_segments(turns, "conv_id", "turn")


@query("subtitle_pick", f"""
select doc_id, name, coalesce(transcript, '') as transcript from (select doc_id from @documents) left join (
select doc_id, name, transcript from (
  select f.doc_id, f.name, f.rank, min(f.rank) over (partition by f.doc_id) as best, t.transcript from (
    select doc_id, name, body, case name when 'sub.zh-Hans.srt' then 0 when 'sub.zh-Hans.vtt' then 1 when 'sub.en.srt' then 2 else 3 end as rank
    from v_subtitle_files) f
  join (select doc_id, name, string_agg(line, ' ' order by pos) as transcript from (
    select doc_id, name, line, min(pos) as pos from (
      select doc_id, name, trim(line, chr(9) || chr(13) || ' ') as line, pos from (
        select doc_id, name, unnest(l) as line, unnest(generate_series(1, len(l))) as pos
        from (select doc_id, name, string_split(body, chr(10)) as l from v_subtitle_files)))
    where {SPOKEN} group by 1, 2, 3) group by 1, 2) t on t.doc_id = f.doc_id and t.name = f.name) where rank = best) using (doc_id)
""")
def subtitle_pick(spark, sf):
    items = spark_sql(spark, sf, "select doc_id from @documents")
    best = transcripts.pick_subtitles(view(spark, sf, "v_subtitle_files"), "doc_id", ["zh-Hans", "en"], items=items)
    return best.select("doc_id", "name", or_empty(text.subtitle_transcript(F.col("body"))).alias("transcript"))


@query("image_proxy", r"""
select doc_id, regexp_replace(content, '(https?://mmbiz\.qpic\.cn/[^\s)]+)', 'https://wsrv.nl/?url=\1', 'g') as content from v_images
""")
def image_proxy(spark, sf):
    return view(spark, sf, "v_images").withColumn("content", text.proxy_images(F.col("content")))


SAFE_SQL = r"""coalesce(nullif(substr(regexp_replace(trim(regexp_replace({}, '[\\/:*?"<>|]', '-', 'g'),
  chr(9) || chr(10) || chr(13) || ' '), '\s+', ' ', 'g'), 1, 110), ''), 'untitled')"""


@query("safe_filename", f"""
select doc_id, {SAFE_SQL.format('title')} as name,
  case when doc_id < 1000 then lpad(cast(doc_id as varchar), 3, '0') else cast(doc_id as varchar) end || '-' || {SAFE_SQL.format('title')} || '.html' as file
from v_titles
""")
def safe_filename(spark, sf):
    return view(spark, sf, "v_titles").select(
        "doc_id", text.safe_name(F.col("title")).alias("name"),
        text.numbered_name(F.col("doc_id"), F.col("title")).alias("file"),
    )


@query("page_title", f"select page_id, {TITLE_SQL} as title from @pages")
def page_title(spark, sf):
    return spark_sql(spark, sf, "select page_id, html from @pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query("page_main_text", f"""
select page_id, case page_id % 4 when 2 then trim('in' || chr(10) || content, chr(10)) when 3 then whole else content end as content
from (select page_id, {ARTICLE_SQL} as content, {BODY_SQL} as whole from @pages)
""")
def page_main_text(spark, sf):
    return view(spark, sf, "v_main_pages").select("page_id", html.main_text(F.col("html")).alias("content"))


@query("dom_walk_images", """
select doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), chr(1) || '![image](https://mmbiz.qpic.cn/'
  || cast(doc_id as varchar) || ')' || chr(1)) || chr(1) || '![image](s.png)', chr(1)), lambda x: trim(x, chr(9) || ' ')), lambda x: x <> ''),
  chr(10) || chr(10)) as content from @documents
""")
def dom_walk_images(spark, sf):
    return view(spark, sf, "v_dom").select("doc_id", html.walk_with_images(F.col("html")).alias("content"))


LINES_SQL = (r"regexp_replace(regexp_replace(regexp_replace({}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), "
             r"'^[ \n]+|[ \n]+$', '', 'g')")


@query("xhs_note", f"""
select doc_id, 'Note ' || cast(doc_id as varchar) || ' & more' as title,
  {LINES_SQL.format('text')} || case when doc_id % 3 = 0 then '' else chr(10) || chr(10) || '03-' || cast(doc_id as varchar) end as content,
  case when doc_id % 2 = 0 then 'u' else 'i' end || cast(doc_id as varchar) as author from @documents
""")
def xhs_note(spark, sf):
    return view(spark, sf, "v_notes").select("doc_id", html.note_fields(F.col("html")).alias("n")).select("doc_id", "n.*")


@query("tweet_dom", f"""
select doc_id, case when doc_id % 4 = 3 then '' else {LINES_SQL.format('text')} end as text from @documents
""")
def tweet_dom(spark, sf):
    return view(spark, sf, "v_posts").select("doc_id", html.post_text(F.col("html")).alias("text"))


@query("strip_scripts", r"""
select page_id, regexp_replace(regexp_replace(html || '<script src="z.js" />', '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?i)<script\b[^>]*/>', '', 'g') as html from @pages
""")
def strip_scripts(spark, sf):
    pages = spark_sql(spark, sf, """select page_id, html || '<script src="z.js" />' as html from @pages""")
    return pages.withColumn("html", html.strip_scripts(F.col("html")))


@query("strip_patterns", r"""
select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<nav>.*?</nav>', '', 'g'), '(?is)<FOOTER>.*?</footer>', '', 'g'), '(?is)</?b>', '', 'g') as html from @pages
""")
def strip_patterns(spark, sf):
    pages = spark_sql(spark, sf, "select page_id, html from @pages")
    return pages.withColumn("html", html.strip_patterns(F.col("html"), ["<nav>.*?</nav>", "<FOOTER>.*?</footer>", "</?b>"]))


@query("theme_rewrite", r"""
select page_id, regexp_replace(regexp_replace(html, '(?i)(<html\b[^>]*\bclass=")light"', '\1dark"'), 'color-scheme: light', 'color-scheme: dark') as html from v_themed
""")
def theme_rewrite(spark, sf):
    return view(spark, sf, "v_themed").withColumn("html", html.rewrite_theme(F.col("html"), "dark"))


@query("data_uri", "select doc_id, 'data:text/plain;base64,' || base64(encode(text)) as uri from @documents")
def data_uri(spark, sf):
    docs = spark_sql(spark, sf, "select doc_id, text from @documents")
    return docs.select("doc_id", html.data_uri(F.lit("text/plain"), F.encode("text", "UTF-8")).alias("uri"))


# Snapshot parts: the page, a frame, two styles (the second has no place in the page), two images.
VIEWS["v_parts"] = """
select page_id, k as part_no,
  case k when 1 then 'https://s.example.org/' || n when 2 then 'https://s.example.org/a' || n || '.css'
    when 3 then 'https://s.example.org/b.css' when 4 then 'https://s.example.org/i' || n || '.png'
    when 5 then 'cid:f' || n else '' end as location,
  case when k = 1 and page_id % 17 = 0 then 'text/plain' when k in (1, 5) and (k = 1 or page_id % 17 <> 0) then 'text/html'
    when k in (2, 3) then 'text/css' when k = 5 then 'image/gif' else 'image/png' end as content_type,
  case k when 1 then replace(replace(html, '<head>', '<head><LINK rel="stylesheet" href="https://s.example.org/a' || n
        || '.css"/><link href="https://s.example.org/a' || n || '.css">'), '<article>',
        '<article><img src="https://s.example.org/i' || n || '.png"><iframe src="cid:f' || n || '"></iframe>')
    when 2 then 'body{background:url(https://s.example.org/i' || n || '.png) $1}'
    when 3 then 'i{}' when 4 then 'PNG' || n when 5 then '<p>frame ' || n || '</p>' else 'lost' end as body
from (select page_id, html, cast(page_id as string) as n, @each(1,6) as k from @pages) p
"""


def _gathered(spark, sf):
    parts = view(spark, sf, "v_parts").withColumn("data", F.encode("body", "UTF-8")).drop("body")
    return snapshot.gather_parts(parts)


@query("snapshot_parts", """
select page_id, max(case when content_type = 'text/html' and part_no = 1 then length(body) end) as main_chars,
  sum(case when content_type = 'text/css' then 1 else 0 end) as n_css,
  sum(case when content_type = 'text/css' or (part_no = 1 and content_type = 'text/html') then 0 else 1 end) as n_resources,
  max(case when page_id % 17 = 0 then 'no main html part' end) as error from v_parts group by page_id
""")
def snapshot_parts(spark, sf):
    return _gathered(spark, sf).select(
        "page_id", F.length("main").alias("main_chars"), F.size("css").alias("n_css"),
        F.size("resources").alias("n_resources"), "error",
    )


@query("inline_snapshot", r"""
select page_id, regexp_replace(replace(replace(regexp_replace(main, '(?i)<link\b[^>]*href="https://s\.example\.org/a' || n || '\.css"[^>]*>',
    '<style>' || chr(10) || replace(css, img, img_uri) || chr(10) || '</style>'), img, img_uri), 'cid:f' || n, frame_uri), '(?is)<footer>.*?</footer>', '', 'g') as page_html
from (select page_id, n, 'https://s.example.org/i' || n || '.png' as img, 'data:image/png;base64,' || base64(encode('PNG' || n)) as img_uri,
    'data:text/html;base64,' || base64(encode('<p>frame ' || n || '</p>')) as frame_uri,
    'body{background:url(https://s.example.org/i' || n || '.png) $1}' as css,
    regexp_replace(body, '(?is)<script\b[^>]*>.*?</script>', '', 'g') as main
  from (select page_id, cast(page_id as varchar) as n, body from v_parts where part_no = 1 and page_id % 17 <> 0))
""")
def inline_snapshot(spark, sf):
    whole = _gathered(spark, sf).filter("error is null")
    return snapshot.inline(whole, "dark", ["<footer>.*?</footer>"]).select("page_id", "page_html")
