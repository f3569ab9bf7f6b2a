"""Queries over records: ids, JSON, converters and the router."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import html, urls
from weir.model import RECORD_DDL, RECORD_FIELDS, content_id, flat, json_value, record_columns
from weir.operators import convert
from weir.operators.inbox import first_wins
from weir.plans.addresses import NETLOC, platform_sql
from weir.plans.landed import AS_OF, VIEWS, spark_sql, view
from weir.plans.registry import query, record_sql
from weir.sinks.exports import with_json
from weir.sources.payloads import embed_payloads, post_payloads, video_payloads
from weir.session import fresh_path
from weir.sources.records import load_arrays, read_inbox_files, records_from_json


def inbox_records(df):
    """v_inbox rows as records, arrival order in ``seq``."""
    names = ["url", "source_type", "source_name", "title", "content", "fetched_at", "processed"]
    return df.select("seq", *record_columns(AS_OF, **{n: F.col(n) for n in names}))


VIEWS["v_records"] = """
select seq, substr(md5(url), 1, 12) as id, url, source_type, source_name, title, content, fetched_at, processed from v_inbox
"""
VIEWS["v_store"] = """
select * from (select *, row_number() over (partition by id order by seq) as rn from v_records) where rn = 1
"""
VIEWS["v_ids"] = """
select seq, url, case when seq % 4 = 0 then 'given' || cast(seq as string) else '' end as id,
  case when seq % 3 = 0 then '' else fetched_at end as fetched_at from v_inbox
"""


@query("content_id", f"""
select seq, coalesce(nullif(id, ''), substr(md5(url), 1, 12)) as id, coalesce(nullif(fetched_at, ''), '{AS_OF}') as fetched_at from v_ids
""")
def content_ids(spark, sf):
    return view(spark, sf, "v_ids").select(
        "seq", content_id(F.col("url"), F.col("id")).alias("id"),
        F.coalesce(F.nullif("fetched_at", F.lit("")), F.lit(AS_OF)).alias("fetched_at"),
    )


def _json_objects(spark, sf):
    """One JSON object per row: strange enumerations, missing keys, unknown keys and broken text among them."""
    return spark_sql(spark, sf, """
        select seq, case when seq % 17 = 0 then substr(j, 1, length(j) - 5) else j end as raw from (
          select doc_id as seq, to_json(named_struct('source_type', if(doc_id % 11 = 0, 'bogus', 'rss'),
            'source_name', source, 'title', if(doc_id % 13 = 0, null, substr(text, 1, 100)), 'content', text,
            'url', 'https://d.example.org/' || md5(text), 'score', doc_id % 5,
            'processed', if(doc_id % 2 = 0, true, null), 'unknown', doc_id)) as j from @documents)""")


GOOD_JSON = "doc_id % 17 <> 0 and doc_id % 11 <> 0 and doc_id % 13 <> 0"


@query("record_from_json", f"""
select doc_id as seq, case when doc_id % 17 = 0 then 'undecodable' when doc_id % 11 = 0 then 'bad source_type: bogus'
    when doc_id % 13 = 0 then 'missing: title' end as error,
  case when {GOOD_JSON} then substr(md5('https://d.example.org/' || md5(text)), 1, 12) end as id,
  case when {GOOD_JSON} then substr(text, 1, 100) end as title, case when {GOOD_JSON} then 'text' end as media_type,
  case when {GOOD_JSON} then doc_id % 5 end as score, case when {GOOD_JSON} then doc_id % 2 = 0 end as processed
from @documents
""")
def record_from_json(spark, sf):
    df = records_from_json(_json_objects(spark, sf), "raw", AS_OF, ["seq"])
    kept = ["id", "title", "media_type", "score", "processed"]
    return df.select("seq", "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in kept])


@query("inbox_load", """
select cast(floor(seq / 100) as bigint) as file_no, cast(seq % 100 as bigint) as pos, substr(md5(url), 1, 12) as id, title, source_type, processed
from v_inbox where cast(floor(seq / 100) as bigint) % 4 <> 3
""")
def inbox_load(spark, sf):
    rows = with_json(inbox_records(view(spark, sf, "v_inbox")), "seq")
    # Exports of 100 records each; every fourth file breaks off and counts as empty.
    files = rows.groupBy(F.floor(F.col("seq") / 100).alias("file_no")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "json"))).alias("items")
    )
    text = F.concat(F.lit("["), F.array_join(F.col("items.json"), ","), F.when(F.col("file_no") % 4 == 3, "").otherwise("]"))
    loaded = load_arrays(files.select("file_no", text.alias("raw")), "raw", AS_OF, ["file_no"])
    return loaded.select("file_no", F.col("pos").cast("bigint").alias("pos"), "id", "title", "source_type", "processed")


@query("inbox_files", """
select file_no, case when file_no % 3 = 1 then null else cast(pos as integer) end as pos, case when file_no % 3 <> 1 then id end as id,
  case when file_no % 3 <> 1 and not bad then title end as title,
  case when file_no % 3 = 1 then 'undecodable file' when bad then 'bad source_type: bogus' end as error
from (select cast(floor(seq / 100) as integer) as file_no, seq % 100 as pos, substr(md5(url), 1, 12) as id, title, seq % 50 = 7 as bad from v_inbox where seq < 600)
where file_no % 3 <> 1 or pos = 0
union all select i, null, null, null, 'no such file' from (select unnest([0, 1, 2, 3, 4, 5, 99]) as i)
where i not in (select cast(floor(seq / 100) as integer) from v_inbox where seq < 600)
""")
def inbox_files(spark, sf):
    """JSON-array files: whole ones, some with a strange enumeration value, every third cut off, and one that is not there."""
    root = fresh_path(spark, "exports")
    rows = inbox_records(view(spark, sf, "v_inbox").filter("seq < 600"))
    rows = with_json(rows.withColumn("source_type", F.when(F.col("seq") % 50 == 7, "bogus").otherwise(F.col("source_type"))), "seq")
    files = rows.groupBy(F.floor(F.col("seq") / 100).cast("int").alias("file_no")).agg(F.array_sort(F.collect_list(F.struct("seq", "json"))).alias("items"))
    text = F.concat(F.lit("["), F.array_join(F.col("items.json"), ","), F.when(F.col("file_no") % 3 == 1, "").otherwise("]"))
    files.select("file_no", text.alias("value")).write.partitionBy("file_no").text(root)
    paths = {i: f"{root}/file_no={i}" for i in [*range(6), 99]}
    loaded = read_inbox_files(spark, list(paths.values()), AS_OF)
    number = F.regexp_extract("file", "file_no=([0-9]+)", 1).cast("int")
    good = lambda c: F.when(F.col("error").isNull(), F.col(c))
    known = F.when(F.coalesce(F.col("error"), F.lit("")).startswith("bad") | F.col("error").isNull(), F.col("id"))
    return loaded.select(number.alias("file_no"), "pos", known.alias("id"), good("title").alias("title"), "error")


@query("record_roundtrip", "select seq, true as same from v_inbox")
def record_roundtrip(spark, sf):
    kinds = {"text": F.col("title"), "digits": F.lit("0123"), "whole": F.col("seq"), "long": F.lit(1234567890123456789),
             "part": F.col("seq") + F.lit(0.5), "flag": F.col("seq") % 2 == 0, "list": F.array(F.lit(1), F.col("seq")), "none": F.lit(None).cast("string")}
    extra = F.create_map(*[x for key, value in kinds.items() for x in (F.lit(key), json_value(value))])
    full = inbox_records(view(spark, sf, "v_inbox")).withColumns({"extra": extra, "tags": F.array("source_name", F.lit('t"'))})
    rows = with_json(full, "seq")
    back = records_from_json(rows, "json", AS_OF, ["seq", "json"])
    return with_json(back.withColumnRenamed("json", "before"), "seq", "before").select(
        "seq", (F.col("json") == F.col("before")).alias("same")
    )


@query("inbox_json", """
select seq, cast(json_object('source_type', source_type, 'source_name', source_name, 'title', title, 'content', content, 'url', url,
  'id', id, 'fetched_at', fetched_at, 'media_type', 'text', 'media_url', null, 'score', 0, 'priority', 'normal', 'category', '',
  'tags', cast('[]' as json), 'processed', processed, 'digest_date', null, 'title_cn', null, 'content_cn', null,
  'extra', json_object('channel', source_name, 'views', seq)) as varchar) as json from v_records
""")
def inbox_json(spark, sf):
    rows = inbox_records(view(spark, sf, "v_inbox"))
    extra = F.create_map(F.lit("views"), json_value(F.col("seq")), F.lit("channel"), json_value(F.col("source_name")))
    return with_json(rows.withColumn("extra", extra), "seq")


def _docs(spark, sf, columns):
    return spark_sql(spark, sf, f"select doc_id, {columns} from @documents")


@query("convert_telegram", record_sql(
    "v_telegram where text is not null", "msg_id", source_type="'telegram'", source_name="channel", title="substr(text, 1, 100)",
    content="text", url="'https://t.me/' || channel || '/' || cast(msg_id as varchar)",
    extra="""'{"views":' || cast(views as varchar) || ',"channel_username":"' || channel || '"}'"""))
def convert_telegram(spark, sf):
    msgs = view(spark, sf, "v_telegram").filter("text is not null")
    msgs = msgs.withColumn("url", urls.telegram_message_url(F.col("channel"), F.col("msg_id")))
    return flat(convert.convert(msgs, "telegram", AS_OF, ["msg_id"]), "msg_id")


@query("convert_rss", record_sql(
    "@documents", "doc_id", source_type="'rss'", source_name="source", title="trim(split_part(text, chr(10), 1))",
    content="trim(text)", url="case when doc_id % 10 = 0 then '' else 'https://r.example.org/' || cast(doc_id as varchar) end",
    score="doc_id % 5", category="lang", title_cn="case when doc_id % 3 = 0 then 'cn' end"))
def convert_rss(spark, sf):
    items = _docs(spark, sf, """source, trim(split_part(text, chr(10), 1)) as title, trim(text) as summary,
        if(doc_id % 10 = 0, '', 'https://r.example.org/' || doc_id) as url, doc_id % 5 as score, lang as category,
        if(doc_id % 3 = 0, 'cn', null) as title_cn""")
    return flat(convert.convert(items, "rss", AS_OF, ["doc_id"]), "doc_id")


def _videos(spark, sf):
    return spark_sql(spark, sf, """
        select doc_id, 'https://www.bilibili.com/video/BV1x' || doc_id || '?p=1' as url, if(doc_id % 9 = 0,
          to_json(named_struct('code', -404, 'message', 'gone')),
          to_json(named_struct('code', 0, 'message', '0', 'data', named_struct('title', text,
            'desc', if(doc_id % 5 = 0, null, text), 'owner', if(doc_id % 4 = 0, null, named_struct('name', source)),
            'pic', 'https://i.example.org/' || doc_id, 'duration', doc_id % 1000,
            'stat', if(doc_id % 6 = 0, null, named_struct('view', doc_id * 3)))))) as payload
        from @documents""")


VIEWS["v_videos"] = """
select doc_id, doc_id % 9 <> 0 as ok, 'BV1x' || cast(doc_id as string) as bvid, text as title,
  case when doc_id % 5 = 0 then '' else text end as description, case when doc_id % 4 = 0 then '' else source end as author,
  'https://www.bilibili.com/video/BV1x' || cast(doc_id as string) as url, 'https://i.example.org/' || cast(doc_id as string) as cover,
  doc_id % 1000 as duration, case when doc_id % 6 = 0 then 0 else doc_id * 3 end as view_count from @documents
"""


@query("bilibili_payload", """
select doc_id, case when not ok then 'service error: gone' end as error, case when ok then title else '' end as title,
  case when ok then description else '' end as description, case when ok then author else '' end as author, url,
  case when ok then cover else '' end as cover, bvid, case when ok then duration else 0 end as duration,
  case when ok then view_count else 0 end as view_count from v_videos
""")
def bilibili_payload(spark, sf):
    return video_payloads(_videos(spark, sf), keep=["doc_id"])


@query("convert_bilibili", record_sql(
    "v_videos where ok", "doc_id", source_type="'bilibili'", source_name="author", title="title", content="description", url="url",
    media_type="'video'", media_url="cover",
    extra="""'{"bvid":"' || bvid || '","duration":' || cast(duration as varchar) || ',"view_count":' || cast(view_count as varchar) || '}'"""))
def convert_bilibili(spark, sf):
    good = video_payloads(_videos(spark, sf), keep=["doc_id"]).filter("error is null")
    return flat(convert.convert(good, "bilibili", AS_OF, ["doc_id"]), "doc_id")


def _posts(spark, sf):
    return spark_sql(spark, sf, """
        select doc_id, 'https://x.com/u' || doc_id || '/status/' || doc_id as url, to_json(named_struct('tweet',
          if(doc_id % 7 = 0, null, named_struct('text', text, 'author', named_struct('name', source,
            'screen_name', if(doc_id % 3 = 0, null, 'u' || doc_id)))))) as payload from @documents""")


@query("tweet_payload", """
select doc_id, case when doc_id % 7 = 0 then '' else text end as text,
  case when doc_id % 7 = 0 or doc_id % 3 = 0 then '' else '@u' || cast(doc_id as varchar) end as author,
  case when doc_id % 7 = 0 then '' else source end as author_name, case when doc_id % 7 = 0 then '' else substr(text, 1, 100) end as title from @documents
""")
def tweet_payload(spark, sf):
    return post_payloads(_posts(spark, sf), keep=["doc_id"])


@query("convert_twitter", record_sql(
    "@documents", "doc_id", source_type="'twitter'", source_name="case when doc_id % 7 = 0 or doc_id % 3 = 0 then '' else '@u' || cast(doc_id as varchar) end",
    title="case when doc_id % 7 = 0 then '' else substr(text, 1, 100) end", content="case when doc_id % 7 = 0 then '' else text end",
    url="'https://x.com/u' || cast(doc_id as varchar) || '/status/' || cast(doc_id as varchar)", extra="""'{"likes":0,"retweets":0}'"""))
def convert_twitter(spark, sf):
    return flat(convert.convert(post_payloads(_posts(spark, sf), keep=["doc_id", "url"]), "twitter", AS_OF, ["doc_id"]), "doc_id")


@query("convert_wechat", record_sql(
    "@documents", "doc_id", source_type="'wechat'", source_name="source", title="text", content="text",
    url="'https://mp.weixin.qq.com/s/' || cast(doc_id as varchar)"))
def convert_wechat(spark, sf):
    docs = _docs(spark, sf, "source as author, text as title, text as content, 'https://mp.weixin.qq.com/s/' || doc_id as url")
    return flat(convert.convert(docs, "wechat", AS_OF, ["doc_id"]), "doc_id")


@query("convert_xhs", record_sql(
    "@documents", "doc_id", source_type="'xhs'", source_name="source", title="text", content="text",
    url="'https://www.xiaohongshu.com/explore/' || cast(doc_id as varchar)",
    media_type="case when doc_id % 3 = 0 then 'image' else 'text' end",
    extra="""'{"likes":' || cast(doc_id % 7 as varchar) || ',"collects":0}'"""))
def convert_xhs(spark, sf):
    docs = _docs(spark, sf, """source as author, text as title, text as content,
        'https://www.xiaohongshu.com/explore/' || doc_id as url, doc_id % 7 as likes,
        case doc_id % 3 when 0 then array('a.png') when 1 then cast(array() as array<string>) end as images""")
    return flat(convert.convert(docs, "xhs", AS_OF, ["doc_id"]), "doc_id")


@query("convert_youtube", record_sql(
    "@documents", "doc_id", source_type="'youtube'", source_name="source", title="text", content="text",
    url="'https://youtu.be/' || cast(doc_id as varchar)", media_type="'video'", extra="""'{"duration":"","view_count":0}'"""))
def convert_youtube(spark, sf):
    docs = _docs(spark, sf, "source as author, text as title, text as description, 'https://youtu.be/' || doc_id as url")
    return flat(convert.convert(docs, "youtube", AS_OF, ["doc_id"]), "doc_id")


@query("convert_manual", record_sql(
    "@documents", "doc_id", source_type="'manual'", source_name="'manual'", title="text", content="text",
    url="case when doc_id % 2 = 0 then 'manual://' || substr(md5(text), 1, 8) else 'https://e.example.org/' || cast(doc_id as varchar) end"))
def convert_manual(spark, sf):
    docs = _docs(spark, sf, "text as title, text as content, if(doc_id % 2 = 0, '', 'https://e.example.org/' || doc_id) as url")
    return flat(convert.convert(docs, "manual", AS_OF, ["doc_id"]), "doc_id")


@query("convert_generic", record_sql(
    "v_page_text", "page_id", source_type="'manual'", source_name="regexp_extract(url, '^https?://([^/?#]*)', 1)",
    title="title", content="content", url="url"))
def convert_generic(spark, sf):
    pages = spark_sql(spark, sf, "select page_id, url, html from @pages")
    read = pages.select("page_id", "url", html.page_title(F.col("html")).alias("title"), html.main_text(F.col("html")).alias("content"))
    return flat(convert.convert(read, "generic", AS_OF, ["page_id"]), "page_id")


@query("page_inbox", f"""
select page_id, id, platform, source_name, title, n_chars from (
  select page_id, substr(md5(url), 1, 12) as id, {platform_sql('url', NETLOC.format(u='url'))} as platform,
    regexp_extract(url, '^https?://([^/?#]*)', 1) as source_name, title, length(content) as n_chars,
    row_number() over (partition by url order by page_id) as rn from v_page_text) where rn = 1
""")
def page_inbox(spark, sf):
    """Flagship: raw pages to de-duplicated records; the page text never reaches the shuffle."""
    pages = spark_sql(spark, sf, "select page_id, url, html from @pages")
    u, body = urls.normalise(F.col("url")), F.col("html")
    rows = pages.select(
        "page_id", content_id(u).alias("id"), urls.platform(u).alias("platform"), urls.authority(u).alias("source_name"),
        html.page_title(body).alias("title"), F.length(html.main_text(body)).alias("n_chars"),
    )
    return first_wins(rows, "id", "page_id")


PAYLOAD_DDL = (
    "channel string, text string, views bigint, source string, title string, summary string, score int, "
    "category string, title_cn string, summary_cn string, description string, author string, cover string, bvid string, "
    "duration bigint, view_count bigint, likes bigint, retweets bigint, collects bigint, images array<string>, content string"
)
VIEWS["v_routed"] = f"""
select doc_id, url, {platform_sql('url', NETLOC.format(u='url'))} as platform, source, text, lang
from (select * exclude (url), case when starts_with(url, 'http://') or starts_with(url, 'https://') then url else 'https://' || url end as url from v_doc_urls)
"""


def _case(**by_platform):
    other = by_platform.pop("other")
    return "case platform " + " ".join(f"when '{k}' then {v}" for k, v in by_platform.items()) + f" else {other} end"


FINAL_URL = _case(
    twitter="replace(url, 'twitter.com', 'x.com')", bilibili=r"'https://www.bilibili.com/video/' || regexp_extract(url, 'BV\w+')",
    rss="case when doc_id % 3 = 0 then '' else url || '#item' end", other="url")


@query("unified_all", record_sql(
    "v_routed", "doc_id, platform", source_type="case when platform in ('podcast', 'generic') then 'manual' else platform end",
    source_name=_case(telegram="'c' || lang", rss="source", bilibili="source", twitter="source", wechat="source", xhs="source",
                      youtube="source", other="regexp_extract(url, '^https?://([^/?#]*)', 1)"),
    title=_case(telegram="substr(text, 1, 100)", twitter="substr(text, 1, 100)", other="text"),
    content=_case(rss="text", bilibili="'d ' || text", youtube="'d ' || text", telegram="text", twitter="text", other="'c ' || text"),
    url=FINAL_URL, media_type=_case(bilibili="'video'", youtube="'video'", xhs="case when doc_id % 2 = 0 then 'image' else 'text' end", other="'text'"),
    media_url=_case(bilibili="'cover'", other="null"), score=_case(rss="doc_id % 5", other="0"), category=_case(rss="lang", other="''"),
    title_cn=_case(rss="'cn'", other="null"), content_cn=_case(rss="'scn'", other="null"),
    extra=_case(telegram="""'{"views":' || cast(doc_id as varchar) || ',"channel_username":"c' || lang || '"}'""",
                bilibili=r"""'{"bvid":"' || regexp_extract(url, 'BV\w+') || '","duration":' || cast(doc_id % 1000 as varchar) || ',"view_count":7}'""",
                twitter="""'{"likes":1,"retweets":2}'""", xhs="""'{"likes":1,"collects":3}'""",
                youtube="""'{"duration":' || cast(doc_id % 1000 as varchar) || ',"view_count":7}'""", other="'{}'")))
def unified_all(spark, sf):
    """Landed payloads of all platforms, one JSON text each, routed and converted in a single scan."""
    payload = """to_json(named_struct('channel', 'c' || lang, 'text', text, 'views', doc_id, 'source', source,
        'title', text, 'summary', text, 'score', doc_id % 5, 'category', lang, 'title_cn', 'cn',
        'summary_cn', 'scn', 'description', 'd ' || text, 'author', source, 'cover', 'cover', 'duration', doc_id % 1000,
        'view_count', 7, 'likes', 1, 'retweets', 2, 'collects', 3, 'images', if(doc_id % 2 = 0, array('i'), array()),
        'content', 'c ' || text))"""
    asked = F.col("request_url")
    landed = view(spark, sf, "v_doc_urls").select(
        "doc_id", urls.normalise(F.col("url")).alias("request_url"), F.from_json(F.expr(payload), PAYLOAD_DDL).alias("_landed"),
    ).withColumn("platform", urls.platform(asked))
    item_url = F.when(
        F.col("platform") == "rss", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(asked, F.lit("#item")))
    )
    ready = landed.select("doc_id", "platform", "request_url", "_landed.*", item_url.alias("url"))
    return flat(convert.convert_routed(ready, AS_OF, ["doc_id", "platform"]), "doc_id", "platform")
