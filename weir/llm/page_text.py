"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by itself: by the
part of the page it stands in, its link density, its length and its density of stop words. Short
and doubtful blocks stay open; the second pass gives them the label of their nearest decided
neighbours, and headings that of the text they lead to. Where article and main elements hold most
of the text that passes the rules, they frame it: blocks outside go, and doubtful blocks inside
stay unless they stand between blocks of links.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset((
    "the of and to in is that it for was on as are with be by this at from or have an not but he they his which you were all "
    "le la les de des du et un une en est que qui dans pour pas sur par au avec ce il se ne plus ou sont "
    "der die das und ein eine den von zu mit sich auf für ist im dem nicht des als auch es an werden aus er hat "
    "el los las y del que con una por para no su al lo como más pero sus se es son").split())
# Elements by what they mean for the text.
BLOCKS = frozenset(("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                    "frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
                    "thead tr ul").split())
SILENT = frozenset("script style head noscript template textarea select iframe svg math object audio video canvas button title".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
CONTAINERS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table tbody td th tr ul".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|adsense|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|side|rail|menu|nav|navbar|"
    r"navigation|breadcrumbs?|footer|foot|masthead|comments?|commentlist|disqus|replies|respond|related|recommended|recommendations|share|sharing|social|subscribe|"
    r"subscription|newsletter|promo|promotion|sponsor|sponsored|widget|pagination|pager|toolbar|login|signup|search|tags|copyright|disclaimer|skip)(?:$|[-_\s\d])")
#: Names that also stand on elements around a whole article.
SOFT_NAMES = re.compile(
    r"(?:^|[-_\s])(?:banner|notices?|alert|popup|modal|overlay|side|rail|top|topbar|head|header|masthead|share|sharing|social|subscribe|subscription|promo|promotion|widget|"
    r"login|signup|search|tags|skip|related|recommended)(?:$|[-_\s\d])")
#: Elements that a head may hold; any other one begins the body.
HEAD = frozenset("title meta link script style base noscript template head html".split())
HEAD_NAMES = re.compile(r"(?:^|[-_\s])(?:header|head|topbar|top)(?:$|[-_\s\d])")
#: Of an article element: one that is no part of the main article.
CARD_NAMES = re.compile(r"(?:^|[-_\s])(?:comments?|reply|replies|ads?|advert|promo|sponsored|related|teaser)(?:$|[-_\s\d])")
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[/a-zA-Z][^>]*>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SENTENCE = re.compile(r"[.!?…][\"'”’»)]*$")
LETTERS = re.compile(r"[^\W\d_]+")


SOFT, HARD = 1, 2


@dataclass
class Block:
    text: str
    linked: int      # characters inside links
    heading: bool
    outside: int     # HARD in a part of the page that never holds the main text, SOFT in one that rarely does
    inside: bool     # in an article or main element


def _side(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element opens a part without main text: HARD, SOFT (by a name that articles bear, too) or 0."""
    if tag in OUTSIDE or tag == "header" and not inside:
        return HARD
    if "=" not in attributes or tag in ("html", "body", "main"):
        return 0
    if tag == "article":
        return HARD * any(name.lower() in ("class", "id") and bool(CARD_NAMES.search((a or b or c).lower())) for name, a, b, c in ATTRIBUTE.findall(attributes))
    soft = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return HARD
        if name in ("class", "id"):
            if NAMES.search(SOFT_NAMES.sub(" ", value)):
                return HARD
            if NAMES.search(value) or not inside and HEAD_NAMES.search(value):
                soft = SOFT
    return HARD if "hidden" in re.sub(ATTRIBUTE, "", attributes).lower().split() else soft


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with white space collapsed and references decoded."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # (tag, outside, inside)
    at, link, heading, silent = 0, 0, False, ""
    outside, inside = 0, False
    end = len(page)
    lower = ""

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = len(" ".join(entities.unescape("".join(t for t, in_link in parts if in_link)).split()))
                out.append(Block(text, linked, heading, outside, inside))
            parts.clear()

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            if not silent:
                parts.append((page[at:], link > 0))
            break
        if m.start() > at and not silent:
            parts.append((page[at:m.start()], link > 0))
        at = m.end()
        if m.group(2) is None:
            continue
        close, tag = m.group(1) == "/", m.group(2).lower()
        if silent:
            if close and tag == silent:
                silent = ""
                continue
            if silent != "head" or close or tag in HEAD:
                continue
            silent = ""  # the head has no end tag: its first other element is the body's
        if tag in SILENT and not close:
            if m.group(3).endswith("/"):
                continue
            if tag in RAW:  # their content is no markup
                lower = lower or page.lower()
                stop = lower.find("</" + tag, at)
                at = end if stop < 0 else stop
            if tag in BLOCKS:
                flush()
            silent = tag
            continue
        if tag == "a":
            link = 0 if close else 1
        if tag not in BLOCKS and tag not in CONTAINERS:
            if not close and tag not in VOID and "=" in m.group(3) and tag == "span" and _side(tag, m.group(3), inside):
                flush()
                stack.append((tag, outside, inside))
                outside = max(outside, _side(tag, m.group(3), inside))
            elif close and tag == "span" and stack and stack[-1][0] == "span":
                flush()
                _, outside, inside = stack.pop()
            continue
        flush()
        link = link if tag == "br" else 0
        if tag[0] == "h" and len(tag) == 2 and tag[1].isdigit():
            heading = not close
        elif tag != "br":
            heading = False
        if tag in CONTAINERS:
            if not close:
                stack.append((tag, outside, inside))
                outside = max(outside, _side(tag, m.group(3), inside))
                inside = inside or tag in ("article", "main")
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        _, outside, inside = stack[i]
                        del stack[i:]
                        break
        elif tag in ("p", "li", "dd", "dt"):
            if stack and stack[-1][0] == tag:  # its end tag, or the next one where that is missing
                _, outside, inside = stack.pop()
            if not close and m.group(3) and _side(tag, m.group(3), inside):
                stack.append((tag, outside, inside))
                outside = max(outside, _side(tag, m.group(3), inside))
    flush()
    return out


def first_pass(found: list[Block], short: int = 70, long: int = 200, links: float = 0.33, low: float = 0.12, high: float = 0.2) -> list[str]:
    """good, bad, near (good, but not long), short or low (few stop words) for each block, by itself."""
    out = []
    for b in found:
        density = b.linked / max(1, len(b.text))
        if b.outside:
            out.append("bad")
        elif density > links:
            out.append("short" if b.inside and len(b.text) < short else "bad")
        elif len(b.text) < short:
            out.append("bad" if b.linked and not b.inside else "short")
        else:
            words = LETTERS.findall(b.text.lower())
            stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            out.append("good" if stop >= high and len(b.text) >= long else "near" if stop >= low else "low")
    return out


def framed(found: list[Block], labels: list[str]) -> bool:
    """Whether article and main elements hold most of the text that passes the rules; where no block of
    the page has stop words enough, of all text in blocks long enough; where there is none, whether there are any."""
    for passing in (("good", "near"), ("low",)):
        held = [(len(b.text), b.inside) for b, label in zip(found, labels) if label in passing]
        if held:
            return 2 * sum(n for n, inside in held if inside) >= sum(n for n, _ in held)
    return any(b.inside and not b.outside for b in found)


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Open blocks inherit from the nearest decided ones; before the first one all is bad, behind the last one
    what ends like a sentence is like it.

    On framed pages only blocks inside the frame are left, and beyond the frame's ends all is good.
    """
    frame = framed(found, labels)
    if frame:
        labels = ["bad" if b.outside or not b.inside else x for b, x in zip(found, labels)]
    else:
        labels = ["bad" if x == "low" else x for x in labels]
    n = len(found)
    # What is no part of a frame says nothing about the text inside.
    decided = [x in ("good", "bad") and (not frame or b.inside and not b.outside) for b, x in zip(found, labels)]
    edge = "good" if frame else "bad"
    before, after = [edge] * n, [edge] * n
    last = edge
    for i in range(n):
        before[i] = last
        last = labels[i] if decided[i] else last
    tail, last = last, None
    for i in range(n - 1, -1, -1):
        # Outside of a frame an article is a card, no end of the text.
        after[i] = last or (tail if not frame and not found[i].inside and SENTENCE.search(found[i].text) else edge)
        last = labels[i] if decided[i] else last
    keep = []
    for i, label in enumerate(labels):
        near = (before[i], after[i])
        if label in ("good", "bad"):
            keep.append(label == "good")
        elif found[i].heading:
            keep.append(after[i] == "good")
        elif label in ("near", "low") or frame:
            keep.append("good" in near)
        else:
            keep.append(near == ("good", "good"))
    return keep


def _unmasked(found: list[Block]) -> list[Block]:
    """``found``, where parts with a doubtful name hold three quarters of the text that passes the rules: as if they had none."""
    if not any(b.outside == SOFT for b in found):
        return found
    plain = [Block(b.text, b.linked, b.heading, HARD if b.outside == HARD else 0, b.inside) for b in found]
    held = [(len(b.text), a.outside == SOFT) for a, b, label in zip(found, plain, first_pass(plain)) if label in ("good", "near")]
    return plain if 4 * sum(n for n, soft in held if soft) > 3 * sum(n for n, _ in held) else found


def page_text(page: str | None) -> str:
    """Main text of one page: kept blocks, one space between; '' where no block is left outside of menus, footers and the like."""
    if not page:
        return ""
    found = _unmasked(blocks(page))
    keep = second_pass(found, first_pass(found))
    if not any(keep):  # no known stop words and no article: long blocks with few links
        keep = [not b.outside and len(b.text) >= 70 and b.linked <= 0.33 * len(b.text) for b in found]
    if not any(keep):  # short ones only
        keep = [not b.outside and 2 * b.linked <= len(b.text) for b in found]
    return " ".join(b.text for b, k in zip(found, keep) if k)


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of ``pages`` with text and n_chars (code points); NULL and empty pages give ''.

    Every row gives one row, repeated ones too. Other columns are not read.
    """
    kept = pages.select(*keep).schema

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [page_text(value.as_py()) for value in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             [*batch.schema.names[:len(keep)], "text", "n_chars"])

    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(extract, kept.add("text", "string").add("n_chars", "long"))
