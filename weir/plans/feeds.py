"""Queries over feeds, channels and batches of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import channels, inbox
from weir.operators.numbering import add_ordinal
from weir.plans.landed import AS_OF, VIEWS, spark_sql, view
from weir.plans.registry import query
from weir.sources.feeds import read_feeds
from weir.sources.payloads import join_results

ITEMS_PER_FEED = 50

VIEWS["v_rss_items"] = """
select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as n,
  trim(replace(split_part(text, chr(10), 1), chr(10), ' ')) as title,
  case when doc_id % 10 = 0 then null else 'https://' || source || '.example.org/' || cast(doc_id as string) end as link,
  trim(replace(text, chr(10), ' ')) as summary
from @documents
"""
VIEWS["v_feed_items"] = f"""
select 'https://' || source || '.example.org/feed/' || cast(page as string) as feed_url, n % {ITEMS_PER_FEED} as pos,
  case when page % 4 = 3 then 'https://' || source || '.example.org/feed/' || cast(page as string) else 'Feed ' || source end as source,
  case when doc_id % 37 <> 5 then title end as title, case when doc_id % 37 <> 5 then summary end as summary, case when doc_id % 37 <> 5 then coalesce(link, '') end as url,
  case when doc_id % 37 = 5 then null when doc_id % 2 = 0 then '' else '2024-01-' || cast(doc_id as string) end as published,
  case when doc_id % 37 = 5 then 'undecodable entry' end as error
from (select *, cast(floor(n / {ITEMS_PER_FEED}) as bigint) as page from v_rss_items)
"""


def landed_feeds(spark, sf):
    """Feed documents of 50 items each, RSS and Atom by turns, some without a title; every 37th item is broken; plus feeds with no items."""
    items = spark_sql(spark, sf, """
        select source, doc_id, trim(replace(split_part(text, chr(10), 1), chr(10), ' ')) as title,
          if(doc_id % 10 = 0, null, 'https://' || source || '.example.org/' || doc_id) as link,
          trim(replace(text, chr(10), ' ')) as summary,
          if(doc_id % 2 = 0, null, '2024-01-' || doc_id) as published from @documents""")
    numbered = add_ordinal(items, ["source"], "doc_id", "n", start=0)
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), escape(c), F.lit(f"</{name}>")), F.lit(""))
    page = F.floor(F.col("n") / ITEMS_PER_FEED)
    bodied = F.col("doc_id") % 5 == 0
    rss = F.concat(
        F.lit("<item>"), tag("title", F.col("title")), tag("link", F.col("link")),
        F.when(bodied, tag("content:encoded", F.col("summary"))).otherwise(tag("description", F.col("summary"))),
        tag("pubDate", F.col("published")), F.lit("</item>"),
    )
    atom = F.concat(
        F.lit('<entry xml:lang="x">'), tag("title", F.col("title")),
        F.coalesce(F.concat(F.lit('<link rel="self" href="s"/><link href="'), escape(F.col("link")), F.lit('"/>')), F.lit("")),
        F.when(bodied, tag("content", F.col("summary"))).otherwise(tag("summary", F.col("summary"))),
        tag("published", F.col("published")), F.lit("</entry>"),
    )
    # At most 50 items meet in one group.
    whole = F.when(page % 2 == 0, rss).otherwise(atom)
    broken = F.when(F.col("doc_id") % 37 == 5, F.regexp_replace(whole, "<title>", "<title><b>")).otherwise(whole)
    docs = numbered.select("source", "n", page.alias("page"), broken.alias("x")).groupBy(
        "source", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]), "\n").alias("body"))
    title = F.when(F.col("page") % 4 == 3, "").otherwise(F.concat(F.lit("<title>Feed "), F.col("source"), F.lit("</title>")))
    xml = F.when(
        F.col("page") % 2 == 0, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel>'), title, F.col("body"), F.lit("</channel></rss>"))
    ).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), title, F.col("body"), F.lit("</feed>")))
    feeds = docs.select(F.concat(F.lit("https://"), "source", F.lit(".example.org/feed/"), "page").alias("feed_url"), xml.alias("xml"))
    empty = spark_sql(spark, sf, """select 'https://empty.example.org/' || doc_id as feed_url,
        '<rss><channel><title>none</title></channel></rss>' as xml from @documents where doc_id % 200 = 0""")
    return feeds.unionByName(empty)


@query("rss_entries", """
select feed_url, pos, source, title, summary, url, published, error from v_feed_items where pos < 20
union all select 'https://empty.example.org/' || cast(doc_id as varchar), null, 'none', null, null, null, null, 'no entries in feed' from @documents where doc_id % 200 = 0
""")
def rss_entries(spark, sf):
    """Entries, broken entries and feeds without any, from one pass."""
    return read_feeds(landed_feeds(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


@query("rss_latest", """
select feed_url, title, url, error from v_feed_items where pos = 0
union all select 'https://empty.example.org/' || cast(doc_id as varchar), null, null, 'no entries in feed' from @documents where doc_id % 200 = 0
""")
def rss_latest(spark, sf):
    return read_feeds(landed_feeds(spark, sf), limit=1).select("feed_url", "title", "url", "error")


def recent_sql(hours):
    return f"""
select {hours} as hours, channel, msg_id, text, views, replace(strftime(date, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || '+00:00' as date,
  'https://t.me/' || channel || '/' || cast(msg_id as varchar) as url
from (select *, ts as date, max(case when text is not null and ts < timestamp '2024-01-31 00:00:00' - interval {hours} hour then 1 else 0 end)
    over (partition by channel order by msg_id desc rows between unbounded preceding and current row) as stopped
  from (select *, row_number() over (partition by channel order by msg_id desc) as rn from v_telegram) where rn <= 20)
where text is not null and stopped = 0"""


@query("telegram_recent", recent_sql(24) + " union all " + recent_sql(2))
def telegram_recent(spark, sf):
    msgs = view(spark, sf, "v_telegram")
    run = lambda hours: channels.recent_messages(msgs, AS_OF, hours=hours).select(
        F.lit(hours).alias("hours"), "channel", "msg_id", "text", "views", "date", "url")
    return run(24).unionByName(run(2))


@query("telegram_latest", """
select channel, msg_id, case when text is not null and ts >= timestamp '2024-01-30 00:00:00' then text end as text,
  text is not null and ts >= timestamp '2024-01-30 00:00:00' as ok
from (select *, row_number() over (partition by channel order by msg_id desc) as rn from v_telegram) where rn = 1
""")
def telegram_latest(spark, sf):
    return channels.latest_message(view(spark, sf, "v_telegram"), AS_OF).select("channel", "msg_id", "text", "ok")


VIEWS["v_outcomes"] = """
select cast(floor(page_id / 10) as bigint) as batch_id, page_id % 10 as pos, page_id, page_id % 6 = 1 as missing, page_id % 6 = 5 as failed from @pages
"""


def _outcomes(spark, sf):
    requests = spark_sql(spark, sf, "select cast(floor(page_id / 10) as bigint) as batch_id, page_id % 10 as pos, url from @pages")
    results = spark_sql(spark, sf, """
        select cast(floor(page_id / 10) as bigint) as batch_id, page_id % 10 as pos, if(page_id % 6 = 5, null, 'T' || page_id) as title,
          if(page_id % 6 = 5, 'timeout', null) as error from @pages where page_id % 6 <> 1""")
    return join_results(requests, results, ["batch_id", "pos"])


@query("read_batch", """
select o.batch_id, o.pos, p.url, case when not missing and not failed then 'T' || cast(p.page_id as varchar) end as title,
  case when missing then 'no result' when failed then 'timeout' end as error, not missing and not failed as ok
from v_outcomes o join @pages p on p.page_id = o.page_id
""")
def read_batch(spark, sf):
    return _outcomes(spark, sf).select("batch_id", "pos", "url", "title", "error", "ok")


@query("batch_stats", """
select batch_id, count(*) as n_requested, count(*) filter (where not missing and not failed) as n_fetched from v_outcomes group by batch_id
""")
def batch_stats(spark, sf):
    return _outcomes(spark, sf).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_requested"), F.count_if("ok").alias("n_fetched"))
