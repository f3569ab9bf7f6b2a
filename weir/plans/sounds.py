"""Queries over media: segment plans, digest forms and the rolling budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import media
from weir.operators.rolling import rolling_sum
from weir.plans.landed import view
from weir.plans.registry import query


@query("audio_plan", """
select event_id, size_bytes > 26214400 as over_binary_limit, size_bytes > 25000000 as over_limit, 0 as segment, cast(0 as bigint) as start_sec, duration_sec as length_sec
from v_media where size_bytes <= 25000000
union all select event_id, size_bytes > 26214400, true, i, i * 600, least(600, duration_sec - i * 600)
from (select *, unnest(generate_series(0, cast(ceil(duration_sec / 600.0) as bigint) - 1)) as i from v_media where size_bytes > 25000000)
""")
def audio_plan(spark, sf):
    size = F.col("size_bytes")
    return view(spark, sf, "v_media").select(
        "event_id", media.over_limit(size, media.UPLOAD_LIMIT_BINARY).alias("over_binary_limit"),
        media.over_limit(size, media.UPLOAD_LIMIT_DECIMAL).alias("over_limit"),
        F.posexplode(media.segments(F.col("duration_sec"), size)).alias("segment", "_s"),
    ).select("event_id", "over_binary_limit", "over_limit", "segment", "_s.start_sec", "_s.length_sec")


@query("digest_form", """
select event_id, case when duration_sec <= 1200 then 'video' else 'podcast' end as form, duration_sec > 7200 as confirm from v_media
""")
def digest_form(spark, sf):
    d = F.col("duration_sec")
    return view(spark, sf, "v_media").select("event_id", media.digest_form(d).alias("form"), media.needs_confirmation(d).alias("confirm"))


@query("rolling_budget", """
select event_id, user_id, used_sec, used_sec > 7200 as over_budget from (
  select event_id, user_id, cast(sum(duration_sec) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as bigint) as used_sec from v_media)
""")
def rolling_budget(spark, sf):
    used = rolling_sum(view(spark, sf, "v_media"), "user_id", "ts", "duration_sec", "used_sec", 3600)
    return used.select("event_id", "user_id", "used_sec", (F.col("used_sec") > media.ROLLING_BUDGET_SECONDS).alias("over_budget"))
