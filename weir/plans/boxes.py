"""Queries over the inbox: adding, state, retention, listings and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import inbox
from weir.plans.landed import AS_OF, VIEWS, spark_sql, view
from weir.plans.records import inbox_records
from weir.plans.registry import query
from weir.session import fresh_path
from weir.sinks.exports import with_markdown, write_markdown
from weir.sinks.recent import RecentRecords
from weir.sinks.store import InboxStore

EMOJI = ("case source_type when 'telegram' then '📢' when 'rss' then '📰' when 'bilibili' then '🎬' when 'xhs' then '📕' "
         "when 'twitter' then '🐦' when 'wechat' then '💬' when 'youtube' then '▶️' when 'manual' then '✏️' else '📄' end")


def _rows(spark, sf):
    return inbox_records(view(spark, sf, "v_inbox"))


def _store(spark, sf):
    return inbox.first_wins(_rows(spark, sf))


def _landed(spark, sf, root):
    """The batch written once: every use of it reads the files."""
    rows = _rows(spark, sf)
    rows.write.parquet(f"{root}/landed")
    return spark.read.schema(rows.schema).parquet(f"{root}/landed")


def _filled(spark, sf):
    """A written store with all records added."""
    store = InboxStore(spark, f"{fresh_path(spark, 'inbox')}/store")
    store.add(_rows(spark, sf))
    return store


VIEWS["v_added"] = """
select b.seq, b.id, b.seq = f.first and s.id is null as added from (select seq, id from v_records where seq % 3 <> 0) b
join (select id, min(seq) as first from v_records where seq % 3 <> 0 group by id) f on f.id = b.id
left join (select distinct id from v_records where seq % 3 = 0) s on s.id = b.id
"""


def _added(spark, sf):
    rows = _rows(spark, sf)
    store = inbox.first_wins(rows.filter("seq % 3 = 0"))
    return inbox.added_flags(rows.filter("seq % 3 <> 0"), store)


@query("inbox_add", "select seq, id, added from v_added")
def inbox_add(spark, sf):
    return _added(spark, sf)


@query("inbox_add_count", "select count(*) as n_offered, count(*) filter (where added) as n_added from v_added")
def inbox_add_count(spark, sf):
    return _added(spark, sf).agg(F.count(F.lit(1)).alias("n_offered"), F.count_if("added").alias("n_added"))


@query("inbox_append", """
select seq, id, source_type, title from (select r.*, row_number() over (partition by id order by seq) as rn from v_records r where seq % 3 <> 0) r
where rn = 1 and id not in (select id from v_records where seq % 3 = 0)
""")
def inbox_append(spark, sf):
    """The rows an append writes, content and all: membership is asked of a written store's ids."""
    rows = _rows(spark, sf)
    store = InboxStore(spark, f"{fresh_path(spark, 'inbox')}/store")
    store.add(rows.filter("seq % 3 = 0"))
    batch = rows.filter("seq % 3 <> 0")
    return inbox.new_records(batch, store.known(batch)).select("seq", "id", "source_type", "title")


@query("inbox_unprocessed", "select seq, id, title from v_store where not processed")
def inbox_unprocessed(spark, sf):
    return inbox.unprocessed(_store(spark, sf)).select("seq", "id", "title")


@query("inbox_by_source", "select seq, id, title from v_store where source_type = 'rss'")
def inbox_by_source(spark, sf):
    return inbox.by_source(_filled(spark, sf).load(), "rss").select("seq", "id", "title")


@query("inbox_clear_old", """
select 7 as days, seq, id, fetched_at from v_store where fetched_at > '2024-01-24T00:00:00'
union all select 6 as days, seq, id, fetched_at from v_store where fetched_at > '2024-01-25T00:00:00'
""")
def inbox_clear_old(spark, sf):
    """Retention of a written store, twice: what each version keeps."""
    store = _filled(spark, sf)
    kept = []
    for days in (7, 6):
        store.clear_old(AS_OF, days)
        kept.append(store.load().select(F.lit(days).alias("days"), "seq", "id", "fetched_at"))
    return kept[0].unionByName(kept[1])


@query("inbox_mark_processed", """
select s.seq, s.id, s.processed or u.id is not null as processed, u.digest_date from v_store s left join (
  select id, max(case when seq % 15 <> 0 then '2024-02-' || lpad(cast(1 + last % 28 as varchar), 2, '0') end) as digest_date
  from (select id, seq, max(case when seq % 15 <> 0 then seq end) over (partition by id) as last from v_records where seq % 5 = 0) group by id) u on u.id = s.id
""")
def inbox_mark_processed(spark, sf):
    updates = _rows(spark, sf).filter("seq % 5 = 0").select(
        "id", F.col("seq").alias("update_seq"),
        F.when(F.col("seq") % 15 == 0, "").otherwise(
            F.concat(F.lit("2024-02-"), F.lpad((1 + F.col("seq") % 28).cast("string"), 2, "0"))
        ).alias("digest_date"),
    )
    store = _filled(spark, sf)
    store.mark_processed(updates)
    return store.load().select("seq", "id", "processed", "digest_date")


@query("inbox_last_500", "select seq, id, title from v_records order by seq desc limit 500")
def inbox_last_500(spark, sf):
    return inbox.last_added(_rows(spark, sf), 500).select("seq", "id", "title")


@query("inbox_recent", """
select cast(append as integer) as append, cast(pos as integer) as pos, id, title from (
  select case seq % 3 when 0 then 1 else 3 end as append, id, title,
    least(500, count(*) over (partition by seq % 3)) - row_number() over (partition by seq % 3 order by seq desc) as pos
  from v_records where seq % 3 <> 1) where pos >= 0 order by append desc, pos desc limit 500
""")
def inbox_recent(spark, sf):
    """Three appends to a JSON inbox that keeps 500; the second file broke off and counts as empty."""
    recent = RecentRecords(spark, fresh_path(spark, "recent"))
    rows = _rows(spark, sf)
    recent.append(rows.filter("seq % 3 = 0"))
    broken = rows.filter("seq % 3 = 1").agg(F.concat(F.lit("["), F.min("title")).alias("value"))
    broken.coalesce(1).write.text(recent.next_folder())
    recent.append(rows.filter("seq % 3 = 2"))
    return recent.load(AS_OF).select("append", "pos", "id", "title")


@query("inbox_list", f"""
select 0 as position, case when count(*) = 0 then '📦 Inbox is empty' else '📦 Inbox: ' || cast(count(*) as varchar) || ' items' end as line from v_store
union all select position, '  ' || lpad(cast(position as varchar), 2, ' ') || '. ' || {EMOJI} || ' [' || rpad(source_type, 8, ' ') || '] ' || substr(title, 1, 50) as line
from (select row_number() over (order by seq) as position, source_type, title from (select * from v_store order by seq desc limit 20))
""")
def inbox_list(spark, sf):
    return inbox.listing(_store(spark, sf).select("seq", "source_type", "title"))


MARKDOWN_SQL = (
    f"chr(10) || '## ' || {EMOJI} || ' ' || title || chr(10) || '- Source: ' || source_name || ' (' || source_type || ')' || chr(10) "
    "|| '- URL: ' || url || chr(10) || '- Fetched: ' || substr(fetched_at, 1, 16) || chr(10) || chr(10) || substr(content, 1, 2000) "
    "|| chr(10) || chr(10) || '---' || chr(10)"
)


@query("markdown_render", f"select seq, {MARKDOWN_SQL} as block from v_records")
def markdown_render(spark, sf):
    return with_markdown(_rows(spark, sf), "seq")


@query("dual_sink", f"""
select 'inbox' as sink, count(*) as n_rows, cast(sum(length(content)) as bigint) as n_chars from v_store
union all select 'markdown' as sink, cast(sum(len(string_split(b, chr(10)))) as bigint) as n_rows, cast(sum(length(replace(b, chr(10), ''))) as bigint) as n_chars
  from (select substr(b, 1, length(b) - 1) as b from (select {MARKDOWN_SQL} as b from v_records))
""")
def dual_sink(spark, sf):
    """Both sinks of one batch, written and read back: new records to the store, every record to the log."""
    root = fresh_path(spark, "dual")
    rows = _landed(spark, sf, root)
    store = InboxStore(spark, f"{root}/store")
    store.add(rows)
    write_markdown(rows, f"{root}/log")
    kept = store.load().agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("content")).alias("n_chars"))
    logged = spark.read.text(f"{root}/log").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("value")).alias("n_chars"))
    return kept.select(F.lit("inbox").alias("sink"), "*").unionByName(logged.select(F.lit("markdown").alias("sink"), "*"))


@query("source_counts", "select source as source_name, count(*) as n from @documents group by 1 union all select channel as source_name, count(*) as n from v_telegram group by 1")
def source_counts(spark, sf):
    names = spark_sql(spark, sf, "select source as source_name from @documents")
    channels = view(spark, sf, "v_telegram").select(F.col("channel").alias("source_name"))
    return inbox.source_counts(names.unionByName(channels))
