"""Queries over addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import html, media, urls
from weir.operators import links
from weir.plans.landed import VIEWS, view
from weir.plans.registry import query

# Oracle building blocks.
NORMAL = "case when starts_with(url, 'http://') or starts_with(url, 'https://') then url else 'https://' || url end"
NETLOC = r"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1))"
PATH = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
HOST = (
    "case when starts_with(regexp_replace({n}, '^.*@', ''), '[') then regexp_extract(regexp_replace({n}, '^.*@', ''), "
    r"'^\[([^\]]*)', 1) else split_part(regexp_replace({n}, '^.*@', ''), ':', 1) end"
)


def platform_sql(url: str, netloc: str) -> str:
    hit = lambda hosts: " or ".join(f"contains({netloc}, '{h}')" for h in hosts)
    return (
        f"case when {hit(['mp.weixin.qq.com'])} then 'wechat' when {hit(['x.com', 'twitter.com'])} then 'twitter' "
        f"when {hit(['youtube.com', 'youtu.be'])} then 'youtube' "
        f"when {hit(['xiaohongshu.com', 'xhslink.com'])} then 'xhs' "
        f"when {hit(['bilibili.com', 'b23.tv'])} then 'bilibili' "
        f"when {hit(['xiaoyuzhoufm.com', 'podcasts.apple.com'])} then 'podcast' "
        f"when {hit(['t.me', 'telegram.org'])} then 'telegram' "
        f"when ends_with({url}, '.xml') or contains({url}, '/rss') or contains({url}, '/feed') "
        f"or contains({url}, '/atom') then 'rss' else 'generic' end"
    )


VIEWS["v_normal"] = f"select page_id, {NORMAL} as url from v_urls"
VIEWS["v_net"] = f"select page_id, url, {NETLOC.format(u='url')} as netloc, {PATH.format(u='url')} as path from v_normal"


def _urls(spark, sf):
    return view(spark, sf, "v_urls").withColumn("url", urls.normalise(F.col("url")))


@query("url_normalise", "select page_id, url, 'https://r.jina.ai/' || url as proxy_url from v_normal")
def url_normalise(spark, sf):
    return _urls(spark, sf).withColumn("proxy_url", urls.proxy_url(F.col("url")))


@query("url_parts", f"""
select page_id, regexp_extract(url, '^([a-z]+):', 1) as scheme, netloc, {HOST.format(n='netloc')} as host, path from v_net
""")
def url_parts(spark, sf):
    u = F.col("url")
    return _urls(spark, sf).select(
        "page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"),
        urls.hostname(u).alias("host"), urls.path(u).alias("path"),
    )


@query("detect_platform", f"""
select page_id, url, {platform_sql('url', 'netloc')} as platform,
  case when contains(netloc, 'netflix.com') or contains(netloc, 'media.com') then 'generic'
    else {platform_sql('url', 'netloc')} end as strict_platform
from v_net
""")
def detect_platform(spark, sf):
    u = F.col("url")
    return _urls(spark, sf).select(
        "page_id", "url", urls.platform(u).alias("platform"), urls.platform(u, strict=True).alias("strict_platform")
    )


VIEWS["v_commands"] = """
select doc_id, '--json https://' || source || '.example.org/' || cast(doc_id as string) || ' list www.' || lang
  || ' --out=a.b ' || text as line from @documents
"""


@query("url_candidates", r"""
with words as (select doc_id, unnest(w) as token, unnest(generate_series(0, len(w) - 1)) as pos
  from (select doc_id, string_split_regex(line, '\s+') as w from v_commands))
select doc_id, pos, token from words
where not starts_with(token, '--') and (starts_with(token, 'http') or starts_with(token, 'www.') or contains(token, '.'))
""")
def url_candidates(spark, sf):
    words = view(spark, sf, "v_commands").select("doc_id", F.posexplode(F.split("line", r"\s+")).alias("pos", "token"))
    return words.filter(urls.is_candidate(F.col("token")))


@query("extract_ids", r"""
select page_id, bv as bv_id, bv = '' as bv_missing, case when bv <> '' then 'https://www.bilibili.com/video/' || bv end as video_url,
  regexp_extract(url, '(?:v=|youtu\.be/)([a-zA-Z0-9_-]{11})', 1) as youtube_id
from (select page_id, url, case when contains(url, 'bilibili.com') or contains(url, 'b23.tv')
  then regexp_extract(url, 'BV\w+') else url end as bv from v_normal)
""")
def extract_ids(spark, sf):
    df = _urls(spark, sf).withColumn("bv_id", urls.bv_id(F.col("url")))
    found = F.col("bv_id") != ""
    return df.select(
        "page_id", "bv_id", (~found).alias("bv_missing"), F.when(found, urls.bv_url(F.col("bv_id"))).alias("video_url"),
        urls.youtube_id(F.col("url")).alias("youtube_id"),
    )


@query("tweet_urls", r"""
select page_id, x_url, replace(x_url, 'x.com', 'twitter.com') as embed_url,
  case when regexp_matches(x_url, 'x\.com/\w+/status') then '@' || regexp_extract(x_url, 'x\.com/(\w+)/status', 1) else '' end as author,
  regexp_matches(x_url, 'x\.com/\w+/status/\d+') as is_tweet,
  case when regexp_matches(x_url, 'x\.com/\w+/status/\d+') then 'https://api.fxtwitter.com/'
    || regexp_extract(x_url, 'x\.com/(\w+)/status/(\d+)', 1) || '/status/' || regexp_extract(x_url, 'x\.com/(\w+)/status/(\d+)', 2) end as api_url
from (select page_id, replace(url, 'twitter.com', 'x.com') as x_url from v_normal)
""")
def tweet_urls(spark, sf):
    u = F.col("x_url")
    return _urls(spark, sf).select("page_id", urls.tweet_canonical(F.col("url")).alias("x_url")).select(
        "page_id", "x_url", urls.tweet_embed_query(u).alias("embed_url"), urls.tweet_author(u).alias("author"),
        urls.is_tweet(u).alias("is_tweet"), urls.tweet_api_url(u).alias("api_url"),
    )


@query("telegram_channel", """
select page_id, coalesce(nullif(split_part(trim(path, '/'), '/', 1), ''), url) as channel from v_net
""")
def telegram_channel(spark, sf):
    return _urls(spark, sf).select("page_id", urls.telegram_channel(F.col("url")).alias("channel"))


@query("media_route", """
select event_id, case when contains(url, 'xiaoyuzhoufm.com/episode/') then 'podcast_page'
  when contains(url, 'podcasts.apple.com') then 'podcast_download'
  when contains(url, 'bilibili.com') or contains(url, 'b23.tv') then 'video_api'
  when contains(url, '.mp3') or contains(url, '.m4a') then 'direct_audio' else 'subtitles' end as route from v_media
""")
def media_route(spark, sf):
    return view(spark, sf, "v_media").select("event_id", media.route(F.col("url")).alias("route"))


@query("audio_link", """
select page_id, case when page_id % 3 = 0 then '' else 'https://media.xyzcdn.net/p' || cast(page_id as varchar) || '/ep.'
  || case when page_id % 2 = 0 then 'm4a' else 'mp3' end end as audio_url from @pages
""")
def audio_link(spark, sf):
    return view(spark, sf, "v_episode_pages").select("page_id", html.audio_link(F.col("html")).alias("audio_url"))


VIEWS["v_anchors"] = r"""
select page_id, url, pos, regexp_replace(regexp_extract(a, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1), '^["'']|["'']$', '', 'g') as raw,
  regexp_replace(regexp_replace(a, '<[^>]+>', '', 'g'), '\s+', ' ', 'g') as label
from (select page_id, url, unnest(m) as a, unnest(generate_series(0, len(m) - 1)) as pos from (
  select page_id, url, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'),
    '(?is)<a\s[^>]*href[^>]*>.*?</a\s*>') as m from v_link_pages))
"""
VIEWS["v_joined"] = r"""
select page_id, pos, origin, label, case when regexp_matches(h, '^https?://') then h
  when regexp_matches(h, '^[a-z]+:') then null when starts_with(h, '//') then regexp_extract(url, '^[a-z]+:') || h
  when starts_with(h, '/') then origin || h when h = '' then origin || path || query
  when starts_with(h, '?') then origin || path || h else origin || regexp_replace(path, '[^/]*$', '') || h end as target
from (select page_id, url, pos, replace(label, '&amp;', '&') as label,
  regexp_replace(replace(raw, '&amp;', '&'), '#.*$', '') as h,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path,
  regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) as query from v_anchors)
"""
VIEWS["v_harvest"] = r"""
select page_id, pos, href, text from (
  select page_id, pos, href, trim(label) as text, row_number() over (partition by page_id, href order by pos) as rn
  from (select page_id, pos, origin, label, array_to_string(list_transform(
      regexp_extract_all(regexp_replace(regexp_replace(target, '/[^/]+/\.\./', '/'), '/\./', '/'), '(?s).'),
      lambda c: case when regexp_matches(c, '[\x21-\x7e]') and c not in ('"', '<', '>', '`') then c else url_encode(c) end), '') as href
    from v_joined where target is not null and (starts_with(target, origin || '/') or starts_with(target, origin || '?')))) where rn = 1
"""


def _harvested(spark, sf):
    return links.harvest(view(spark, sf, "v_link_pages"))


@query("harvest_links", "select page_id, pos, href, text from v_harvest")
def harvest_links(spark, sf):
    return _harvested(spark, sf)


@query("link_lines", "select page_id, pos, href || ' | ' || text as line from v_harvest")
def link_lines(spark, sf):
    return _harvested(spark, sf).select("page_id", "pos", links.link_line(F.col("href"), F.col("text")).alias("line"))


@query("merge_links", """
select list_no, page_id, pos, href, text from (select *, row_number() over (partition by href order by list_no, page_id, pos) as rn
  from (select page_id % 2 as list_no, page_id, pos, href, text from v_harvest)) where rn = 1
""")
def merge_links(spark, sf):
    found = _harvested(spark, sf).withColumn("list_no", F.col("page_id") % 2)
    even, odd = found.filter("list_no = 0"), found.filter("list_no = 1")
    return links.merge(odd, even, order=["list_no", "page_id", "pos"])
