"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.text import let, present, present_once

# Service addresses and the ordered host table of the router.
TEXT_PROXY = "https://r.jina.ai"
TWEET_API = "https://api.fxtwitter.com"
PLATFORM_HOSTS = [
    ("wechat", ["mp.weixin.qq.com"]),
    ("twitter", ["x.com", "twitter.com"]),
    ("youtube", ["youtube.com", "youtu.be"]),
    ("xhs", ["xiaohongshu.com", "xhslink.com"]),
    ("bilibili", ["bilibili.com", "b23.tv"]),
    ("podcast", ["xiaoyuzhoufm.com", "podcasts.apple.com"]),
    ("telegram", ["t.me", "telegram.org"]),
]
FEED_MARKS = ["/rss", "/feed", "/atom"]

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
PATH_KEEP = r"[A-Za-z0-9\-._~!$&'()*+,;=:@/%|\[\]\\^]"
QUERY_KEEP = r"[A-Za-z0-9\-._~!$&()*+,;=:@/?%|\[\]\\^`{}]"
FILE_KEEP = r"[A-Za-z0-9\-._~/]"


def any_of(terms: list[Column]) -> Column:
    out = terms[0]
    for term in terms[1:]:
        out = out | term
    return out


def normalise(url: Column) -> Column:
    """``https://`` in front unless the text already starts with http:// or https://."""
    ready = url.startswith("http://") | url.startswith("https://")
    return F.when(ready, url).otherwise(F.concat(F.lit("https://"), url))


def proxy_url(url: Column) -> Column:
    return F.concat(F.lit(TEXT_PROXY + "/"), url)


def tidy(url: Column) -> Column:
    """What a URL parser drops first: leading controls and spaces, inner tabs and newlines."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]+", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(tidy(url), SCHEME, 1))


def authority(url: Column) -> Column:
    """netloc as written: user info and port included."""
    return F.regexp_extract(tidy(url), AUTHORITY, 1)


def netloc(url: Column) -> Column:
    return F.lower(authority(url))


def hostname(url: Column) -> Column:
    """Lower-case host without user info, port or brackets; '' when there is none."""
    return let(
        F.regexp_replace(netloc(url), r"^.*@", ""),
        lambda host: F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)", 1)).otherwise(
            F.substring_index(host, ":", 1)
        ),
    )


def path(url: Column) -> Column:
    return F.regexp_extract(tidy(url), PATH, 1)


def platform(url: Column, strict: bool = False) -> Column:
    """Nine-way cascade, first match wins.

    The default tests host *text* (``netflix.com`` holds ``x.com``); ``strict``
    asks for the domain itself or a subdomain of it.
    """
    def cascade(where: Column) -> Column:
        hit = (lambda h: (where == h) | where.endswith("." + h)) if strict else where.contains
        out = F
        for name, hosts in PLATFORM_HOSTS:
            out = out.when(any_of([hit(h) for h in hosts]), name)
        feed = url.endswith(".xml") | any_of([url.contains(m) for m in FEED_MARKS])
        return out.when(feed, "rss").otherwise("generic")

    return let(hostname(url) if strict else netloc(url), cascade)


def is_candidate(token: Column) -> Column:
    """A free token that may be a URL."""
    return ~token.startswith("--") & (
        token.startswith("http") | token.startswith("www.") | token.contains(".")
    )


def bv_id(url: Column) -> Column:
    """Video id; '' when a video host carries none, the input itself elsewhere."""
    on_host = url.contains("bilibili.com") | url.contains("b23.tv")
    return F.when(on_host, F.regexp_extract(url, r"(?U)BV\w+", 0)).otherwise(url)


def bv_url(bv: Column) -> Column:
    return F.concat(F.lit("https://www.bilibili.com/video/"), bv)


def youtube_id(url: Column) -> Column:
    return F.regexp_extract(url, r"(?:v=|youtu\.be/)([a-zA-Z0-9_-]{11})", 1)


def tweet_canonical(url: Column) -> Column:
    return F.replace(url, F.lit("twitter.com"), F.lit("x.com"))


def tweet_embed_query(url: Column) -> Column:
    return F.replace(url, F.lit("x.com"), F.lit("twitter.com"))


def tweet_author(url: Column) -> Column:
    user = F.regexp_extract(url, r"(?U)x\.com/(\w+)/status", 1)
    return F.when(user != "", F.concat(F.lit("@"), user)).otherwise("")


def is_tweet(url: Column) -> Column:
    return url.rlike(r"(?U)x\.com/\w+/status/\d+")


def tweet_api_url(url: Column) -> Column:
    """Lookup address of one post; NULL when the URL names none."""
    pattern = r"(?U)x\.com/(\w+)/status/(\d+)"
    return F.when(
        is_tweet(url),
        F.concat(
            F.lit(TWEET_API + "/"), F.regexp_extract(url, pattern, 1),
            F.lit("/status/"), F.regexp_extract(url, pattern, 2),
        ),
    )


def telegram_channel(url: Column) -> Column:
    """First path segment, or the whole URL when the path is empty."""
    trimmed = F.btrim(F.regexp_replace(path(url), r";[^/]*$", ""), F.lit("/"))
    return F.coalesce(present_once(F.substring_index(trimmed, "/", 1)), url)


def telegram_message_url(channel: Column, msg_id: Column) -> Column:
    return F.concat(F.lit("https://t.me/"), channel, F.lit("/"), msg_id.cast("string"))


def percent_encode(c: Column, keep: str) -> Column:
    """Percent-encode every character outside the ``keep`` class, as UTF-8."""
    coded = lambda x: F.when(x.rlike(f"^{keep}"), x).otherwise(
        F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    )
    runs = lambda t: F.regexp_extract_all(t, F.lit(f"(?s){keep}+|."), F.lit(0))
    return let(
        c,
        lambda t: F.when(t.rlike(f"^{keep}*$"), t).otherwise(F.array_join(F.transform(runs(t), coded), "")),
    )


def quote_file(c: Column) -> Column:
    return percent_encode(c, FILE_KEEP)


def remove_dot_segments(p: Column) -> Column:
    """Fold ``.`` and ``..`` of an absolute path; a path without them is passed through."""
    one = lambda s: F.lower(s).isin(".", "%2e")
    two = lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e")
    fold = lambda parts: F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(two(s), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(one(s), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    # A trailing dot segment leaves a trailing slash behind.
    closed = lambda t: F.regexp_replace(t, r"(?i)/((?:\.|%2e){1,2})$", "/$1/")
    folded = lambda t: F.concat(
        F.lit("/"), F.array_join(fold(F.split(F.regexp_replace(closed(t), "^/", ""), "/")), "/")
    )
    return let(p, lambda t: F.when(t.rlike(r"(?i)/(?:\.|%2e)"), folded(t)).otherwise(t))


def parts(url: Column) -> Column:
    """struct(scheme, netloc, path, query) of one URL; the query keeps its question mark."""
    return let(
        tidy(url),
        lambda u: F.struct(
            F.lower(F.regexp_extract(u, SCHEME, 1)).alias("scheme"),
            F.lower(F.regexp_extract(u, AUTHORITY, 1)).alias("netloc"),
            F.regexp_extract(u, PATH, 1).alias("path"),
            F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1).alias("query"),
        ),
    )


def origin_of(p: Column) -> Column:
    """scheme://host[:port] of a parts() struct; user info and default ports dropped."""
    host = F.regexp_replace(p["netloc"], r"^.*@", "")
    return F.concat(
        p["scheme"], F.lit("://"),
        F.when(p["scheme"] == "http", F.regexp_replace(host, r":(?:80)?$", "")).otherwise(
            F.regexp_replace(host, r":(?:443)?$", "")
        ),
    )


def origin(url: Column) -> Column:
    return let(parts(url), origin_of)


def join_href(base: Column, own: Column, href: Column) -> Column:
    """``href`` against the parts() struct ``base`` of origin ``own``, before clean-up; NULL for other schemes."""
    folder = F.regexp_replace(base["path"], r"[^/]*$", "")
    return (
        F.when(href.rlike(r"(?i)^https?://"), href)
        .when(href.rlike(SCHEME), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(own, href))
        .when(href == "", F.concat(own, base["path"], base["query"]))
        .when(href.startswith("?"), F.concat(own, base["path"], href))
        .otherwise(F.concat(own, F.coalesce(present(folder), F.lit("/")), href))
    )


def clean_target(joined: Column) -> Column:
    """struct(origin, href): the written form a browser gives an absolute URL."""
    return let(
        parts(joined),
        lambda p: let(
            origin_of(p),
            lambda o: F.struct(
                o.alias("origin"),
                F.concat(
                    o,
                    percent_encode(remove_dot_segments(F.coalesce(present(p["path"]), F.lit("/"))), PATH_KEEP),
                    percent_encode(p["query"], QUERY_KEEP),
                ).alias("href"),
            ),
        ),
    )


def resolve_in(base: Column, own: Column, href: Column) -> Column:
    """struct(origin, href) of a link on a page of parts() ``base`` and origin ``own``; fragment dropped."""
    bare = F.regexp_replace(F.btrim(href, F.lit("".join(map(chr, range(33))))), r"(?s)[\t\r\n]|#.*$", "")
    return let(bare, lambda h: let(join_href(base, own, h), clean_target))


def resolve(base: Column, href: Column) -> Column:
    """Absolute http(s) form of ``href`` on page ``base``; NULL for other schemes."""
    return let(parts(base), lambda b: let(origin_of(b), lambda own: resolve_in(b, own, href)))["href"]
