"""Ordered choice between candidate payloads of the same item.

Candidates are long: one row per (item, tier) with the payload's columns. Each
row is judged on its own; the lowest tier that passes wins, an item with no
passing tier yields an error row. Payload text of failed candidates is dropped
before the shuffle and the rank is limited before it too. Why the tiers before the
winner were refused goes along as one small number per tier, in a hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import gates, urls
from weir.functions.text import or_empty, present, proxy_images, strip

#: Why a candidate is refused; the number in this list is what travels.
CAUSES = ["no answer", "no post address", "empty", "too short", "thin card", "not loaded", "empty title", "captcha", "login wall",
          "no session", "session expired"]
POST_TIERS = ["api", "embed", "proxy", "browser"]
PAGE_TIERS = ["proxy", "browser"]


def refused(*checks: tuple[Column, str]) -> Column:
    """The first cause whose test is true, as its number; NULL if none is: the candidate passes."""
    return F.coalesce(*[F.when(test, F.lit(CAUSES.index(name))) for test, name in checks])


def refusals(judged: DataFrame, item: str, tier: str, tiers: list[str]) -> DataFrame:
    """(item, reason): every tier before the first that passes, with its cause; NULL if the first one passes."""
    numbers = [F.min(F.when(F.col(tier) == t, F.coalesce("_cause", F.lit(-1)))).alias(f"_c{t}") for t in range(1, len(tiers) + 1)]
    per_item = judged.groupBy(item).agg(*numbers)
    return per_item.select(F.col(item).alias("_item"), reason_text({name: F.col(f"_c{t}") for t, name in enumerate(tiers, 1)}).alias("reason"))


def reason_text(causes: dict[str, Column]) -> Column:
    """Text of causes by tier, in order: -1 passes and ends the list, NULL is a tier without an answer."""
    names = F.array(*[F.lit(x) for x in CAUSES])
    lines, open_ = [], F.lit(True)
    for tier, cause in causes.items():
        open_ = open_ & (F.coalesce(cause, F.lit(0)) >= 0)
        lines.append(F.when(open_, F.concat(F.lit(f"{tier}: "), F.get(names, F.coalesce(cause, F.lit(0))))))
    return F.nullif(F.concat_ws("; ", *lines), F.lit(""))


def first_passing(candidates: DataFrame, item: str, tier: str, cause: Column, payload: list[str], tiers: list[str],
                  items: DataFrame | None = None) -> DataFrame:
    """One row per item: the passing candidate of the lowest tier, or NULL payload and ``ok`` false; and the ``reason``.

    ``cause`` is NULL for candidates that pass (see ``refused``), ``tiers`` names the tiers from 1 on.
    With ``items(item)`` those without any candidate come back too.
    """
    judged = candidates.withColumn("_cause", cause).withColumn("ok", F.col("_cause").isNull())
    why = refusals(judged.select(item, tier, "_cause"), item, tier, tiers)
    judged = judged.drop("_cause")
    for name in [*payload, tier]:
        judged = judged.withColumn(name, F.when(F.col("ok"), F.col(name)))
    w = Window.partitionBy(item).orderBy(F.col("ok").desc(), F.col(tier))
    chosen = judged.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    chosen = chosen.join(why, F.col(item) == F.col("_item"), "left").drop("_item")
    if items is None:
        return chosen
    nothing = F.lit("; ".join(f"{name}: {CAUSES[0]}" for name in tiers))
    return items.select(item).distinct().join(chosen, item, "left").withColumns(
        {"reason": F.when(F.col("ok").isNull(), nothing).otherwise(F.col("reason")), "ok": F.coalesce("ok", F.lit(False))})


def choose_post(candidates: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Posts, four tiers: post API, embed card, text proxy, browser.

    ``candidates(item, url, tier, title, text, author)``; the first two tiers
    count only for addresses of one post. The author in the address is
    preferred over the payload's.
    """
    c = candidates.withColumn("url", urls.tweet_canonical(F.col("url")))
    text = or_empty(F.col("text"))
    single = urls.is_tweet(F.col("url"))
    cause = (
        F.when(F.col("tier") == 1, refused((~single, "no post address"), (~gates.api_post_ok(text), "empty")))
        .when(F.col("tier") == 2, refused((~single, "no post address"), (gates.embed_post_thin(text), "thin card")))
        .when(F.col("tier") == 3, refused((gates.trimmed_length(text) <= gates.PROXY_LENGTH, "too short"), (gates.not_loaded(text), "not loaded"),
                                          (gates.empty_post_title(F.col("title")), "empty title")))
        .otherwise(refused((~gates.browser_post_ok(text), "too short")))
    )
    c = c.withColumn("_why", cause)
    # API and embed texts are trimmed when taken, the other two are taken as they are.
    c = c.withColumn("text", F.when(F.col("tier") <= 2, strip(text)).otherwise(text))
    by_url = present(urls.tweet_author(F.col("url")))
    by_payload = F.when(F.col("tier") <= 2, F.col("author"))
    c = c.withColumn("author", F.coalesce(by_url, by_payload, F.lit("")))
    return first_passing(c, "item", "tier", F.col("_why"), ["title", "text", "author"], POST_TIERS, items).drop("_why")


def choose_article(candidates: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Articles, two tiers: proxy text unless it is a captcha stub, else the browser's, if it got one."""
    content = or_empty(F.col("content"))
    cause = F.when(
        F.col("tier") == 1, refused((F.col("content").isNull(), "no answer"), (content == "", "empty"), (gates.article_captcha(content, F.col("title")), "captcha"))
    ).otherwise(refused((F.col("content").isNull(), "no answer")))
    c = candidates.withColumn("_why", cause).withColumn("content", proxy_images(content))
    return first_passing(c, "item", "tier", F.col("_why"), ["title", "content", "author"], PAGE_TIERS, items).drop("_why")


def choose_note(candidates: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Notes: proxy text unless a login wall; the browser needs a saved session that has not expired.

    ``candidates`` also has ``final_url`` and ``has_session`` (browser tier).
    """
    content = or_empty(F.col("content"))
    none = (F.col("content").isNull(), "no answer")
    cause = F.when(
        F.col("tier") == 1, refused(none, (content == "", "empty"), (gates.note_login_wall(content, F.col("title")), "login wall"))
    ).otherwise(refused(none, (~F.coalesce(F.col("has_session"), F.lit(False)), "no session"),
                        (gates.session_expired(F.col("url"), F.col("final_url")), "session expired")))
    c = candidates.withColumn("_why", cause).withColumn("content", content)
    return first_passing(c, "item", "tier", F.col("_why"), ["title", "content", "author"], PAGE_TIERS, items).drop("_why")


def choose_video_text(pages: DataFrame, subtitles: DataFrame, speech: DataFrame, key: str = "url", items: DataFrame | None = None) -> DataFrame:
    """Videos: title from the page (no page, ``ok`` false); text from subtitles, else speech, else the page.

    ``pages(key, title, content)``, ``subtitles(key, transcript)`` and
    ``speech(key, transcript)``; of several transcripts of a key the longest counts. ``reason`` says which
    sources before the one taken had none. With ``items(key)`` those without a page come back too.
    """
    best = lambda df, name: df.groupBy(key).agg(F.max_by("transcript", F.struct(F.length("transcript"), "transcript")).alias(name))
    subs, asr = best(subtitles, "_sub"), best(speech, "_asr")
    asked = pages.withColumn("ok", F.lit(True))
    if items is not None:
        asked = items.select(key).distinct().join(asked, key, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    joined = asked.join(subs, key, "left").join(asr, key, "left")
    transcript = F.coalesce(present(F.col("_sub")), present(F.col("_asr")))
    spoken = lambda name: F.when(present(F.col(name)).isNotNull(), -1).otherwise(CAUSES.index("empty"))
    ok = F.col("ok")
    return (
        joined.withColumn("has_transcript", ok & transcript.isNotNull())
        .withColumn("reason", F.when(~ok, F.lit(f"page: {CAUSES[0]}")).otherwise(reason_text({"subtitles": spoken("_sub"), "speech": spoken("_asr")})))
        .withColumn("description", F.when(ok, F.coalesce(transcript, F.col("content"))))
        .withColumn("video_id", urls.youtube_id(F.col(key)))
        .drop("_sub", "_asr", "content")
    )
