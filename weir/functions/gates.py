"""Quality gates: does a candidate payload hold real content?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.text import or_empty, strip

# Marks of stub pages and the thresholds of the gates.
SHORT_LINK = "https://t.co/"
NOT_LOADED = "not yet fully loaded"
EMPTY_POST_TITLES = ["x", "title: x", ""]
CAPTCHA_MARK = "[去验证]"
CAPTCHA_TITLE = "Weixin Official Accounts Platform"
LOGIN_WALL_TITLE = "小红书 - 你的生活兴趣社区"
LOGIN_WALL_TEXT = "登录后推荐更懂你的笔记"
THIN_LENGTH = 20
PROXY_LENGTH = 100


def trimmed_length(text: Column) -> Column:
    return F.length(strip(or_empty(text)))


def api_post_ok(text: Column) -> Column:
    return trimmed_length(text) > 0


def embed_post_thin(text: Column) -> Column:
    """Too short, only a short link, or a card that ends in one."""
    t = strip(or_empty(text))
    return (
        (F.length(t) <= THIN_LENGTH)
        | F.lower(t).startswith(SHORT_LINK)
        | (t.contains("&mdash;") & t.contains(SHORT_LINK))
    )


def not_loaded(text: Column) -> Column:
    return F.lower(or_empty(text)).contains(NOT_LOADED)


def empty_post_title(title: Column) -> Column:
    return F.lower(or_empty(title)).isin(EMPTY_POST_TITLES)


def proxy_post_ok(text: Column, title: Column) -> Column:
    return (trimmed_length(text) > PROXY_LENGTH) & ~not_loaded(text) & ~empty_post_title(title)


def browser_post_ok(text: Column) -> Column:
    return trimmed_length(text) > THIN_LENGTH


def article_captcha(text: Column, title: Column) -> Column:
    return or_empty(text).contains(CAPTCHA_MARK) | (or_empty(title) == CAPTCHA_TITLE)


def note_login_wall(text: Column, title: Column) -> Column:
    return or_empty(title).contains(LOGIN_WALL_TITLE) | or_empty(text).contains(LOGIN_WALL_TEXT)


def session_expired(url: Column, final_url: Column) -> Column:
    """Landed on another address that is the explore page or a login page."""
    final = or_empty(final_url)
    return (
        (final != "")
        & (final != url)
        & (F.rtrim(final, F.lit("/")).endswith("/explore") | final.contains("login"))
    )


def token_missing(url: Column) -> Column:
    """Note address without its access token; likely to be refused."""
    return ~url.contains("xsec_token") & url.contains("xiaohongshu.com/explore/")
