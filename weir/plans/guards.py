"""Queries over URL safety, quality gates and fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import gates, urls
from weir.functions.text import subtitle_transcript
from weir.operators import archive, fallback, guard
from weir.plans.addresses import HOST
from weir.plans.landed import VIEWS, spark_sql, view
from weir.plans.registry import query

BLANK = "chr(9) || chr(10) || chr(13) || ' '"
REASON = r"""case when scheme not in ('http', 'https') then 'unsupported scheme: ' || scheme when host = '' then 'no hostname'
  when host in ('localhost', 'metadata.google.internal', 'metadata.googleusercontent.com', '169.254.169.254')
    or regexp_matches(host, '\.(localhost|metadata\.google\.internal|metadata\.googleusercontent\.com|169\.254\.169\.254)$') then 'reserved hostname'
  when not contains(host, ':') and not regexp_matches(host, '^[\p{L}\p{M}\p{Nd}.-]*$') then 'invalid hostname characters' end"""
VIEWS["v_guarded"] = f"""
select page_id, url, {REASON} as reason from (
  select page_id, url, regexp_extract(url, '^([a-z]+):', 1) as scheme, {HOST.format(n='netloc')} as host from v_net)
"""


@query("url_guard", "select page_id, url, reason, reason is null as allowed from v_guarded")
def url_guard(spark, sf):
    return guard.with_guard(view(spark, sf, "v_urls").withColumn("url", urls.normalise(F.col("url"))))


@query("ip_guard", """
select h.page_id, h.url, case when h.page_id % 13 in (7, 8) then 'private address' when h.page_id % 13 = 9 then null
    when d.host is null then 'cannot resolve hostname' when d.bad then 'private address' end as reason,
  case when h.page_id % 13 in (7, 8) then false when h.page_id % 13 = 9 then true else d.host is not null and not d.bad end as allowed
from v_hosts h left join (
  select host, bool_or(case when contains(ip, ':') then starts_with(ip, 'fd') or ip = '::1' else
      starts_with(ip, '10.') or starts_with(ip, '127.') or starts_with(ip, '192.168.') or starts_with(ip, '169.254.')
      or regexp_matches(ip, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') end) as bad from v_dns group by host) d
  on h.url = 'https://' || d.host || '/'
""")
def ip_guard(spark, sf):
    return guard.with_address_guard(view(spark, sf, "v_hosts"), view(spark, sf, "v_dns")).select(
        "page_id", "url", "reason", "allowed"
    )


@query("archive_preflight", """
select list, count(*) as n_urls, count(*) filter (where line_no % 40 in (7, 17)) as n_blocked, count(*) filter (where line_no % 40 in (7, 17)) = 0 as may_run
from v_entries group by list
""")
def archive_preflight(spark, sf):
    entries = archive.parse_url_list(view(spark, sf, "v_urllist"))
    bad = F.when(F.col("line_no") % 40 == 7, "http://x.localhost/").when(F.col("line_no") % 40 == 17, "http://10.0.0.5/")
    spoiled = F.coalesce(F.concat(bad, F.col("line_no")), F.col("url"))
    return guard.preflight(entries.withColumn("url", spoiled), "list")


VIEWS["v_entries"] = r"""
select list, line_no, section, url, title, row_number() over (partition by list order by line_no) as index from (
  select list, line_no, kind, url, title, coalesce(last_value(heading ignore nulls) over (
    partition by list order by line_no rows between unbounded preceding and current row), '') as section
  from (select list, line_no, case when line = '' or starts_with(line, '# ') then 'none' when starts_with(line, '##') then 'heading' else 'url' end as kind,
    case when starts_with(line, '##') then trim(ltrim(line, '#')) end as heading,
    case when contains(line, ' | ') then trim(substr(line, 1, strpos(line, ' | ') - 1)) else line end as url,
    case when contains(line, ' | ') then trim(substr(line, strpos(line, ' | ') + 3)) else '' end as title from v_urllist))
where kind = 'url' and (starts_with(url, 'http://') or starts_with(url, 'https://'))
"""


@query("quality_gates", f"""
select doc_id, length(t) > 0 as api_ok, length(t) <= 20 or starts_with(lower(t), 'https://t.co/') or (contains(t, '&mdash;') and contains(t, 'https://t.co/')) as embed_thin,
  length(t) > 100 and not contains(lower(text), 'not yet fully loaded') and lower(title) not in ('x', 'title: x', '') as proxy_ok,
  length(t) > 20 as browser_ok, contains(text, '[去验证]') or title = 'Weixin Official Accounts Platform' as captcha,
  contains(title, '小红书 - 你的生活兴趣社区') or contains(text, '登录后推荐更懂你的笔记') as login_wall, doc_id % 2 = 1 as token_missing
from (select *, trim(text, {BLANK}) as t from v_gates)
""")
def quality_gates(spark, sf):
    text, title = F.col("text"), F.col("title")
    return view(spark, sf, "v_gates").select(
        "doc_id", gates.api_post_ok(text).alias("api_ok"), gates.embed_post_thin(text).alias("embed_thin"),
        gates.proxy_post_ok(text, title).alias("proxy_ok"), gates.browser_post_ok(text).alias("browser_ok"),
        gates.article_captcha(text, title).alias("captcha"), gates.note_login_wall(text, title).alias("login_wall"),
        gates.token_missing(F.col("url")).alias("token_missing"),
    )


@query("session_expired", """
select page_id, case page_id % 5 when 1 then url <> final_url when 2 then true when 4 then contains(url, 'login') else false end as expired from v_visits
""")
def session_expired(spark, sf):
    return view(spark, sf, "v_visits").select(
        "page_id", gates.session_expired(F.col("url"), F.col("final_url")).alias("expired")
    )


@query("tweet_fallback", f"""
with judged as (select doc_id, url, tier, title, case when tier <= 2 then t else text end as text,
    case when tier <= 2 and not is_post then 'no post address' when tier = 1 and length(t) = 0 then 'empty'
      when tier = 2 and (length(t) <= 20 or starts_with(lower(t), 'https://t.co/') or (contains(t, '&mdash;') and contains(t, 'https://t.co/'))) then 'thin card'
      when tier = 3 and length(t) <= 100 then 'too short' when tier = 3 and contains(lower(text), 'not yet fully loaded') then 'not loaded'
      when tier = 3 and lower(title) in ('x', 'title: x', '') then 'empty title' when tier = 4 and length(t) <= 20 then 'too short' end as cause
  from (select *, trim(text, {BLANK}) as t, regexp_matches(url, 'x\\.com/\\w+/status/\\d+') as is_post from v_tiers)),
best as (select doc_id, min(tier) as tier from judged where cause is null group by doc_id),
why as (select j.doc_id, string_agg(case j.tier when 1 then 'api' when 2 then 'embed' when 3 then 'proxy' else 'browser' end || ': ' || cause, '; ' order by j.tier) as reason
  from judged j left join best b on b.doc_id = j.doc_id where j.tier < coalesce(b.tier, 9) group by j.doc_id)
select d.doc_id, b.tier is not null as ok, b.tier, j.title, j.text,
  case when b.tier is null then null when d.doc_id % 9 = 0 then case when b.tier <= 2 then 'p' else '' end else '@u' || cast(d.doc_id as varchar) end as author, w.reason
from @documents d left join best b on b.doc_id = d.doc_id left join judged j on j.doc_id = b.doc_id and j.tier = b.tier left join why w on w.doc_id = d.doc_id
""")
def tweet_fallback(spark, sf):
    c = view(spark, sf, "v_tiers").withColumn("author", F.lit("p")).withColumnRenamed("doc_id", "item")
    return fallback.choose_post(c, _items(spark, sf)).select(F.col("item").alias("doc_id"), "ok", "tier", "title", "text", "author", "reason")


def _items(spark, sf):
    """What was asked for, answered or not."""
    return spark_sql(spark, sf, "select doc_id as item from @documents")


# Proxy answers are stubs for some items; the browser has no answer for others.
VIEWS["v_article_tiers"] = """
select doc_id, tier, case when tier = 1 and doc_id % 6 = 1 then 'Weixin Official Accounts Platform' else 'T' || cast(tier as string) end as title,
  case when tier = 1 and doc_id % 6 = 2 then '[去验证] ' || text when tier = 1 and doc_id % 6 = 3 then ''
    else text || ' https://mmbiz.qpic.cn/' || cast(tier as string) end as content
from (select doc_id, text, @each(1,2) as tier from @documents) d where not (tier = 1 and doc_id % 6 = 4) and not (tier = 2 and doc_id % 12 = 1)
"""


@query("wechat_fallback", r"""
select d.doc_id, c.tier is not null as ok, c.tier, c.title, regexp_replace(c.content, '(https?://mmbiz\.qpic\.cn/[^\s)]+)', 'https://wsrv.nl/?url=\1', 'g') as content,
  'proxy: ' || case d.doc_id % 6 when 1 then 'captcha' when 2 then 'captcha' when 3 then 'empty' when 4 then 'no answer' end
    || case when d.doc_id % 12 = 1 then '; browser: no answer' else '' end as reason
from @documents d left join v_article_tiers c on c.doc_id = d.doc_id and c.tier = case when d.doc_id % 6 in (0, 5) then 1 else 2 end
""")
def wechat_fallback(spark, sf):
    c = view(spark, sf, "v_article_tiers").withColumn("author", F.lit("")).withColumnRenamed("doc_id", "item")
    return fallback.choose_article(c, _items(spark, sf)).select(F.col("item").alias("doc_id"), "ok", "tier", "title", "content", "reason")


VIEWS["v_note_tiers"] = """
select doc_id, tier, url, case when tier = 1 and doc_id % 6 = 1 then '小红书 - 你的生活兴趣社区' else 'T' || cast(tier as string) end as title,
  case when tier = 1 and doc_id % 6 = 2 then '登录后推荐更懂你的笔记' || text when tier = 1 and doc_id % 6 = 3 then '' else text end as content,
  case when tier = 2 and doc_id % 4 = 1 then 'https://www.xiaohongshu.com/explore/' else url end as final_url, tier = 2 and doc_id % 5 <> 0 as has_session
from (select doc_id, text, 'https://www.xiaohongshu.com/explore/' || cast(doc_id as string) as url, @each(1,2) as tier from @documents) d
"""


@query("xhs_fallback", """
select doc_id, tier is not null as ok, tier, case when tier is not null then 'T' || cast(tier as varchar) end as title, case when tier is not null then text end as content,
  'proxy: ' || first || coalesce('; browser: ' || second, '') as reason
from (select *, case when first is null then 1 when second is null then 2 end as tier
  from (select doc_id, text, case when doc_id % 6 = 2 then 'login wall' when text = '' or doc_id % 6 = 3 then 'empty' when doc_id % 6 = 1 then 'login wall' end as first,
    case when doc_id % 5 = 0 then 'no session' when doc_id % 4 = 1 then 'session expired' end as second from @documents))
""")
def xhs_fallback(spark, sf):
    c = view(spark, sf, "v_note_tiers").withColumn("author", F.lit("")).withColumnRenamed("doc_id", "item")
    return fallback.choose_note(c, _items(spark, sf)).select(F.col("item").alias("doc_id"), "ok", "tier", "title", "content", "reason")


@query("youtube_fallback", """
select doc_id, 'https://youtu.be/' || lpad(cast(doc_id as varchar), 11, 'b') as url, lpad(cast(doc_id as varchar), 11, 'b') as video_id, ok,
  case when ok then 'Title ' || cast(doc_id as varchar) end as title, case when ok then coalesce(sub, speech, text) end as description,
  ok and coalesce(sub, speech) is not null as has_transcript,
  case when not ok then 'page: no answer' when sub is null then 'subtitles: empty' || case when speech is null then '; speech: empty' else '' end end as reason
from (select d.doc_id, d.text, d.doc_id % 10 <> 9 as ok, case when d.doc_id % 3 = 0 then nullif(t.transcript, '') end as sub,
    case when d.doc_id % 3 = 1 then 'speech ' || d.text end as speech from @documents d join v_transcript t on t.doc_id = d.doc_id)
""")
def youtube_fallback(spark, sf):
    """Every tenth video has no page: it comes back with its reason."""
    url = "'https://youtu.be/' || lpad(cast(doc_id as string), 11, 'b') as url"
    asked = spark_sql(spark, sf, f"select {url} from @documents")
    pages = spark_sql(spark, sf, f"select {url}, 'Title ' || doc_id as title, text as content from @documents where doc_id % 10 <> 9")
    subtitles = view(spark, sf, "v_srt").filter("doc_id % 3 = 0").select(
        F.expr(url), subtitle_transcript(F.col("body")).alias("transcript"))
    speech = spark_sql(spark, sf, f"select {url}, 'speech ' || text as transcript from @documents where doc_id % 3 = 1")
    number = F.ltrim(F.col("video_id"), F.lit("b")).cast("bigint")
    return fallback.choose_video_text(pages, subtitles, speech, items=asked).select(
        number.alias("doc_id"), "url", "video_id", "ok", "title", "description", "has_transcript", "reason"
    )
