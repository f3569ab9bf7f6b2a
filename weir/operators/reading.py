"""From requests and their landed payloads to records: normalise, guard, route, choose, convert.

A request is one row: its address and a JSON array of the payloads that its tiers gave, in tier order,
null where a tier gave none. Everything happens inside the row, so the same code serves tables and
streams, and nothing is shuffled. Requests that come to nothing are rows with an ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import gates, urls
from weir.functions.text import let, or_empty, proxy_images, strip
from weir.operators import guard
from weir.operators.convert import convert_routed
from weir.operators.fallback import CAUSES, PAGE_TIERS, POST_TIERS, refused
from weir.sinks.exports import write_markdown
from weir.sinks.store import InboxStore

REQUEST_DDL = "seq bigint, url string, payloads string"
PAYLOAD_DDL = (
    "url string, channel string, channel_name string, text string, views bigint, source string, title string, summary string, score int, "
    "category string, title_cn string, summary_cn string, description string, author string, cover string, bvid string, "
    "duration bigint, view_count bigint, likes bigint, retweets bigint, collects bigint, images array<string>, content string, "
    "final_url string, has_session boolean"
)
PAYLOAD_FIELDS = [part.split()[0] for part in PAYLOAD_DDL.split(", ")]
TIERS = {"twitter": POST_TIERS, "wechat": PAGE_TIERS, "xhs": PAGE_TIERS}
#: Platforms without a choice take what their one source gave.
ONE_TIER = ["page"]


def _cause(platform: str, tier: int, p: Column, url: Column) -> Column:
    """Why the payload of a tier (from 0) is refused, as a number of CAUSES; NULL if it passes."""
    none, text, content = (p.isNull(), "no answer"), or_empty(p["text"]), p["content"]
    if platform == "twitter":
        single = (~urls.is_tweet(urls.tweet_canonical(url)), "no post address")
        return refused(none, *[
            [single, (~gates.api_post_ok(text), "empty")],
            [single, (gates.embed_post_thin(text), "thin card")],
            [(gates.trimmed_length(text) <= gates.PROXY_LENGTH, "too short"), (gates.not_loaded(text), "not loaded"), (gates.empty_post_title(p["title"]), "empty title")],
            [(~gates.browser_post_ok(text), "too short")],
        ][tier])
    if platform in ("wechat", "xhs"):
        none = (p.isNull() | content.isNull(), "no answer")
        if tier == 0:
            stub = (gates.article_captcha(content, p["title"]), "captcha") if platform == "wechat" else (gates.note_login_wall(content, p["title"]), "login wall")
            return refused(none, (content == "", "empty"), stub)
        if platform == "xhs":
            return refused(none, (~F.coalesce(p["has_session"], F.lit(False)), "no session"), (gates.session_expired(url, p["final_url"]), "session expired"))
    return refused(none)


def _judged(platform: str, payloads: Column, url: Column) -> Column:
    """struct(at, reason): the place of the first payload that passes (NULL if none does), and why those before it were refused."""
    tiers = TIERS.get(platform, ONE_TIER)

    def cause_of(tier: int) -> Column:
        return let(F.get(payloads, F.lit(tier)), lambda p: F.coalesce(_cause(platform, tier, p, url), F.lit(-1)))

    causes = F.array(*[cause_of(i) for i in range(len(tiers))])
    names, words = F.array(*[F.lit(t) for t in tiers]), F.array(*[F.lit(c) for c in CAUSES])

    def made(c: Column) -> Column:
        at = F.nullif(F.array_position(c, F.lit(-1)), F.lit(0)).cast("int")
        before = F.slice(c, 1, F.coalesce(at - 1, F.lit(len(tiers))))
        lines = F.transform(before, lambda x, i: F.concat(F.get(names, i), F.lit(": "), F.get(words, x)))
        return F.struct((at - 1).alias("at"), F.nullif(F.array_join(lines, "; "), F.lit("")).alias("reason"))

    return let(causes, made)


def read(requests: DataFrame, as_of: str, keep: list[str] | None = None) -> DataFrame:
    """``requests(seq, url, payloads)`` to ``(seq, keep, platform, reason, error, record columns)``, one row each.

    ``error`` says why there is no record (its columns are then of no use): the guard refused the address, the payloads are missing or
    no JSON, or no tier passed. ``reason`` lists the refused tiers before the one taken.
    """
    kept = ["seq", *(keep or [])]
    asked = requests.withColumn("request_url", urls.normalise(or_empty(F.col("url"))))
    host = urls.hostname(F.col("request_url"))
    literal = let(host, lambda h: (h.rlike(guard.IPV4) | h.contains(":")) & guard.in_networks(h))
    refusal = F.coalesce(guard.guard_reason(F.col("request_url")), F.when(literal, "private address"))
    rows = asked.select(*kept, "request_url", refusal.alias("_refusal"), urls.platform(F.col("request_url")).alias("platform"),
                        F.col("payloads").isNull().alias("_none"), F.from_json("payloads", f"array<struct<{PAYLOAD_DDL.replace(' ', ':').replace(',:', ',')}>>").alias("_p"))
    url = F.col("request_url")
    judged = F
    for platform in TIERS:
        judged = judged.when(F.col("platform") == platform, _judged(platform, F.col("_p"), url))
    rows = rows.withColumn("_choice", F.when(F.col("_refusal").isNull() & F.col("_p").isNotNull(), judged.otherwise(_judged("", F.col("_p"), url))))
    at, tweet = F.col("_choice.at"), F.col("platform") == "twitter"
    rows = rows.withColumn("_taken", F.get("_p", at)).withColumn("error", F.coalesce(
        F.concat(F.lit("refused: "), F.col("_refusal")),
        F.when(F.col("_none"), "no payloads").when(F.col("_p").isNull(), "undecodable payloads"),
        F.when(at.isNull(), F.concat(F.lit("no tier passed: "), F.col("_choice.reason")))))
    payload = {name: F.col("_taken")[name] for name in PAYLOAD_FIELDS}
    # API and embed texts are trimmed and name their author; the author in the address comes first.
    payload["text"] = F.when(tweet & (at <= 1), strip(payload["text"])).otherwise(payload["text"])
    by_address = F.when(tweet, F.nullif(urls.tweet_author(urls.tweet_canonical(url)), F.lit("")))
    payload["author"] = F.coalesce(by_address, F.when(~tweet | (at <= 1), payload["author"]))
    payload["content"] = F.when(F.col("platform") == "wechat", proxy_images(payload["content"])).otherwise(payload["content"])
    ready = rows.select(*kept, "platform", "request_url", F.col("_choice.reason").alias("reason"), "error", *[c.alias(n) for n, c in payload.items()])
    return convert_routed(ready, as_of, [*kept, "platform", "reason", "error"])


def keep_read(rows: DataFrame, store: InboxStore, log: str | None, errors: str, part: int = 0) -> None:
    """Records of ``read`` that are new to the store, all records to the log, errors to their folder.

    ``part`` names the folders of log and errors: done again, it replaces its own entries only.
    """
    good = rows.filter("error is null").drop("error", "reason", "platform")
    store.add(good)
    if log:
        write_markdown(good, f"{log}/batch={part:08d}", mode="overwrite")
    rows.filter("error is not null").select("seq", "platform", "error").write.mode("overwrite").parquet(f"{errors}/batch={part:08d}")
