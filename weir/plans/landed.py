"""Landed inputs of the registered queries, built from the driver's tables.

One SQL text serves both sides: ``@name`` stands for a table. The Spark side
reads the parquet file directly, the oracle reads the view of that name.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from weir.sources.tables import table

AS_OF = "2024-01-31T00:00:00"
TABLES = ["pages", "documents", "events", "conversations", "labels"]

VIEWS: dict[str, str] = {}

VIEWS["v_urls"] = """
select page_id, case page_id % 20
  when 0 then 'https://mp.weixin.qq.com/s/p' || n
  when 1 then 'https://x.com/user' || n || '/status/' || n
  when 2 then 'https://mobile.twitter.com/user' || n || '/status/' || n
  when 3 then 'https://www.youtube.com/watch?v=' || lpad(n, 11, 'A')
  when 4 then 'https://youtu.be/' || lpad(n, 11, 'b')
  when 5 then 'https://www.xiaohongshu.com/explore/' || n
  when 6 then 'https://www.bilibili.com/video/BV1x' || n || '?p=1'
  when 7 then 'https://b23.tv/BV1y' || n
  when 8 then 'https://www.xiaoyuzhoufm.com/episode/' || n
  when 9 then 'https://podcasts.apple.com/us/podcast/id' || n
  when 10 then 'https://t.me/chan' || cast(page_id % 7 as string) || '/' || n
  when 11 then 'https://blog.example.org/' || n || '/feed.xml'
  when 12 then 'https://netflix.com/title/' || n
  when 13 then 'https://chat.media.com/' || n
  when 14 then 'example.net/' || n
  when 15 then 'http://localhost/' || n
  when 16 then 'http://10.0.0.' || cast(page_id % 250 as string) || '/x'
  when 17 then 'https://user:pw@Host' || n || '.example.com:8443/a?b=1#c'
  when 18 then 'https://a_b.example.com/' || n
  else url end as url
from (select page_id, url, cast(page_id as string) as n from @pages) p
"""

VIEWS["v_dns"] = """
select 'host' || cast(page_id as string) || '.example.com' as host,
  case page_id % 5 when 0 then '192.168.1.' || cast(page_id % 250 as string)
    when 1 then '8.8.8.8' when 3 then '93.184.216.34' else '172.32.0.1' end as ip
from @pages where page_id % 5 <> 2
union all
select 'host' || cast(page_id as string) || '.example.com' as host, '169.254.1.1' as ip
from @pages where page_id % 5 = 3
union all
select 'host' || cast(page_id as string) || '.example.com' as host,
  case when page_id % 10 = 1 then 'fd12:3456::' || cast(page_id % 1000 as string) else '2001:db8::1' end as ip
from @pages where page_id % 5 = 1
"""

VIEWS["v_hosts"] = """
select page_id, case when page_id % 13 = 7 then 'http://[::1]:8080/' when page_id % 13 = 8 then 'http://172.16.9.9/x'
    when page_id % 13 = 9 then 'http://9.9.9.9/' else 'https://host' || cast(page_id as string) || '.example.com/' end as url
from @pages
"""

VIEWS["v_telegram"] = """
select 'chan' || cast(user_id % 7 as string) as channel, event_id as msg_id, ts,
  case when event_type = 'error' then null else event_type || ' ' || props end as text,
  cast(floor(value) as bigint) as views
from @events
"""

VIEWS["v_cues"] = """
select conv_id, turn, cast(turn + 1 as string) || chr(10)
  || '00:00:' || lpad(cast(turn % 60 as string), 2, '0') || ',000 --> 00:00:'
  || lpad(cast(turn % 60 as string), 2, '0') || ',900' || chr(10)
  || text || chr(10) || case when turn % 3 = 0 then '[Music]' else text end || chr(10) as cue
from @conversations
"""

VIEWS["v_markdown"] = """
select doc_id, case when doc_id % 7 = 0 then '###' || chr(10) else '' end
  || '# Title ' || cast(doc_id as string) || chr(10) || chr(10) || text as body
from @documents
"""

VIEWS["v_tiers"] = """
select d.doc_id, 'https://x.com/u' || cast(d.doc_id as string) || case when d.doc_id % 9 = 0 then ''
    else '/status/' || cast(d.doc_id as string) end as url, d.tier,
  case when d.tier = 3 and d.doc_id % 5 <> 2 then 'X' else 'T' || cast(d.tier as string) end as title,
  case when d.tier = 1 and d.doc_id % 5 = 0 then d.text
    when d.tier = 2 and d.doc_id % 5 = 1 then d.text
    when d.tier = 2 then 'https://t.co/' || cast(d.doc_id as string)
    when d.tier = 3 then d.text
    when d.tier = 4 and d.doc_id % 5 <> 4 then d.text
    else '' end as text
from (select doc_id, text, @each(1,4) as tier from @documents) d
"""

VIEWS["v_inbox"] = """
select d.doc_id as seq, case when d.doc_id % 50 = 0 then ''
    else 'https://d.example.org/' || md5(d.text) end as url,
  case d.doc_id % 8 when 0 then 'telegram' when 1 then 'rss' when 2 then 'bilibili'
    when 3 then 'xhs' when 4 then 'twitter' when 5 then 'wechat' when 6 then 'youtube'
    else 'manual' end as source_type,
  d.source as source_name, substr(d.text, 1, 100) as title, d.text as content,
  '2024-01-' || lpad(cast(1 + d.doc_id % 28 as string), 2, '0')
    || case when d.doc_id % 2 = 0 then 'T00:00:00' else 'T00:00:00.000001' end as fetched_at,
  coalesce(l.quality = 1, false) as processed
from @documents d left join @labels l on l.doc_id = d.doc_id
"""

VIEWS["v_urllist"] = """
select 'list' || cast(cast(floor(page_id / 100) as bigint) as string) as list, page_id as line_no,
  case page_id % 25
    when 0 then '## Section ' || cast(page_id as string)
    when 1 then '# a comment' when 2 then '' when 3 then 'ftp://nope.example.org/x'
    else url || case when page_id % 2 = 1 then ' | Title: ' || cast(page_id as string) || ' a/b?' else '' end
  end as line
from @pages
"""

VIEWS["v_media"] = """
select event_id, user_id, ts, cast(floor(value * 100) as bigint) as duration_sec,
  cast(floor(value * 1000000) as bigint) as size_bytes,
  case event_type when 'view' then 'https://www.xiaoyuzhoufm.com/episode/'
    when 'click' then 'https://podcasts.apple.com/p/' when 'signup' then 'https://b23.tv/BV1'
    when 'error' then 'https://cdn.example.org/a.mp3?' else 'https://youtu.be/' end
    || cast(event_id as string) as url
from @events
"""


VIEWS["v_doc_urls"] = (
    VIEWS["v_urls"].replace("page_id", "doc_id").replace("else url end", "else 'https://d.example.org/' || n end")
    .replace("doc_id, url, cast", "doc_id, text, source, lang, cast").replace("@pages", "@documents")
    .replace("select doc_id, case", "select doc_id, text, source, lang, case")
)

VIEWS["v_episode_pages"] = """
select page_id, case when page_id % 3 = 0 then html else
  '<script id="__NEXT_DATA__">{"enclosure":{"url":"https://media.xyzcdn.net/p' || cast(page_id as string)
  || '/ep.' || case when page_id % 2 = 0 then 'm4a' else 'mp3' end || '"}}</script>' || html end as html
from @pages
"""

VIEWS["v_link_pages"] = """
select page_id, url, replace(html, '</article>', '<a href="a/../b/' || n || '">rel</a><a href=' || chr(39) || '?p=' || n
  || chr(39) || '>q</a><a href="#top">frag</a><a class="x" href="//other.example.org/z">o</a><a href="mailto:a@b.c">m</a>'
  || '<a href="/The">again <b>The</b></a><a href="./c d&amp;e' || n || '">sp &amp; ce</a></article>') as html
from (select page_id, url, html, cast(page_id as string) as n from @pages) p
"""

VIEWS["v_srt"] = """
select doc_id, '1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10)
  || replace(text, chr(10), chr(10) || chr(10) || '2' || chr(10) || '00:00:03,000 --> 00:00:04,000' || chr(10)
     || case when doc_id % 2 = 0 then '[Music]' else 'again' end || chr(10)) || chr(10) as body
from @documents
"""

VIEWS["v_images"] = """
select doc_id, case when doc_id % 11 = 0 then '' else text || ' ![image](https://mmbiz.qpic.cn/mmbiz_png/'
  || cast(doc_id as string) || '/640?wx_fmt=png) http://mmbiz.qpic.cn/x' end as content
from @documents
"""

VIEWS["v_titles"] = """
select doc_id, case when doc_id % 10 = 0 then '' when doc_id % 10 = 1 then ' ' || chr(10) || '  '
  when doc_id % 10 < 5 then 'a/b:c*"d" ' || text else text || ' a/b:c*"d"' end as title
from @documents
"""

VIEWS["v_main_pages"] = """
select page_id, case page_id % 4 when 0 then html
  when 1 then replace(replace(html, '<article>', '<main id="m">'), '</article>', '</main>')
  when 2 then replace(replace(html, '<article>', '<div class="post content"><div>in</div>'), '</article>', '</div>')
  else replace(replace(html, '<article>', ''), '</article>', '') end as html
from @pages
"""

VIEWS["v_escaped"] = """
select doc_id, text, cast(doc_id as string) as n,
  replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as t from @documents
"""

VIEWS["v_dom"] = """
select doc_id, '<html><head><title>W</title></head><body><div id="js_content"><!-- x --><section><p>'
  || replace(t, chr(10), '</p><img class="i" data-src="https://mmbiz.qpic.cn/' || n || '"/><p>')
  || '</p></section><div><img src="s.png"></div></div><div>after</div></body></html>' as html
from v_escaped
"""

VIEWS["v_notes"] = """
select doc_id, '<body><div id="detail-title">Note ' || n || ' &amp; more</div><div id="detail-desc"><div><span>'
  || t || '</span></div></div>' || case when doc_id % 3 = 0 then '' else
  '<div class="bottom-container x">03-' || n || '</div>' end
  || case when doc_id % 2 = 0 then '<div class="author-wrapper"><div class="info"><span class="username">u' || n
     || '<br>follow</span></div></div>' else '<div class="interaction-container">i' || n || '</div>' end
  || '</body>' as html
from v_escaped
"""

VIEWS["v_posts"] = """
select doc_id, case doc_id % 4
  when 0 then '<main>no</main><article>no<div lang="en" data-testid="tweetText">' || t || '</div></article>'
  when 1 then '<main><article>' || t || '</article>rest</main>'
  when 2 then '<div><main>' || t || '</main></div>' else '<div>' || t || '</div>' end as html
from v_escaped
"""

VIEWS["v_themed"] = """
select page_id, case page_id % 3 when 0 then replace(html, '<html lang=', '<html class="light" lang=')
  when 1 then replace(html, 'p{margin:0}', ':root{color-scheme: light}p{color-scheme: light}') else html end as html
from @pages
"""

VIEWS["v_gates"] = """
select doc_id, case doc_id % 8 when 0 then text || ' ' when 1 then 'https://t.co/abc ' || text
    when 2 then text || ' &mdash; u https://t.co/x' when 3 then text || ' page Not Yet Fully Loaded'
    when 4 then '[去验证] ' || text when 5 then '登录后推荐更懂你的笔记' || text
    when 6 then '   ' || text else text end as text,
  case doc_id % 5 when 0 then 'X' when 1 then 'Title: X' when 2 then 'Weixin Official Accounts Platform'
    when 3 then '小红书 - 你的生活兴趣社区 x' else 'ok' end as title,
  'https://www.xiaohongshu.com/explore/' || cast(doc_id as string)
    || case when doc_id % 2 = 0 then '?xsec_token=t' else '' end as url
from @documents
"""

VIEWS["v_visits"] = """
select page_id, url, case page_id % 5 when 0 then url when 1 then 'https://www.xiaohongshu.com/explore/'
  when 2 then 'https://www.xiaohongshu.com/login?r=' || cast(page_id as string) when 3 then '' else url || '/x' end as final_url
from v_urls
"""

VIEWS["v_subtitle_files"] = """
select doc_id, case k when 1 then 'sub.en.srt' when 2 then 'sub.en.vtt' when 3 then 'sub.zh-Hans.vtt' else 'sub.zh-Hans.srt' end as name,
  cast(k as string) || chr(10) || 'file ' || cast(k as string) || chr(10) || text as body
from (select doc_id, text, @each(1,4) as k from @documents) d
where (doc_id + k) % 3 = 0 and doc_id % 7 <> 0
"""


def _expand(sql: str, table, each) -> str:
    sql = re.sub(r"@each\((\d+),(\d+)\)", lambda m: each(m.group(1), m.group(2)), sql)
    return re.sub(r"@(" + "|".join(TABLES) + r")\b", lambda m: table(m.group(1)), sql)


def spark_sql(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run landed-input SQL on Spark over the folder's parquet tables."""
    return spark.sql(_expand(sql, lambda name: _table(spark, folder, name), lambda a, b: f"explode(sequence({a}, {b}))"))


def _table(spark: SparkSession, folder: str, name: str) -> str:
    """Session view over one parquet table; its schema is read once per session."""
    known = f"landed_{name}_{hashlib.md5(folder.encode()).hexdigest()[:10]}"
    if not spark.catalog.tableExists(known):
        table(spark, folder, name).createOrReplaceTempView(known)
    return known


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One landed input; views it is built on become common table expressions."""
    return spark_sql(spark, folder, _with_views(VIEWS[name]))


def _with_views(sql: str) -> str:
    needed, todo = [], [sql]
    while todo:
        for name in re.findall(r"\bv_\w+", todo.pop(0)):
            if name in VIEWS:
                # A view met again moves on, so that it ends up before everything using it.
                needed = [n for n in needed if n != name] + [name]
                todo.append(VIEWS[name])
    views = ",\n".join(f"{n} as ({VIEWS[n]})" for n in reversed(needed))
    if not views:
        return sql
    if sql.lstrip().lower().startswith("with "):
        return f"with {views},\n{sql.lstrip()[5:]}"
    return f"with {views}\n{sql}"


def duck(sql: str) -> str:
    """Oracle text over the registered table views."""
    return _expand(_with_views(sql), lambda name: name, lambda a, b: f"unnest(generate_series({a}, {b}))")
