"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, with blank lines where blocks and
left-out parts stood. The lengths of the lines, weighed by what the page says about them, are summed over sliding windows
of lines; a surge is a line at which the sum reaches a threshold, a dive one at which a whole window
is blank; the lines from each surge to the next dive are kept, and of a page without a surge the densest stretch.
Parts that name their role (scripts, navigation, footers, forms, elements classed as adverts or comments) are blank
from the start. Lines in a marked article weigh more, lines beside one and lines of links less; where
nothing is marked, lengths alone decide.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: Weighed characters in a window that make a surge.
SURGE = 80
#: Weights of the characters of lines in a marked article, and of those beside an article or main part.
INSIDE, BESIDE = 8.0, 0.025
#: Share of characters in links from which a line outside articles counts as a menu line, without weight.
LINKED = 0.6

# Names of HTML elements, and words that class, id and role attributes use.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas audio video select head".split())
LEFT_OUT = frozenset("nav footer aside form button dialog menu fieldset header".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Left-out parts that stand inside a text, which goes on behind them.
BREAKS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion newsletter subscribe subscription share sharing social".split())
NOISE = BREAKS | frozenset(
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay signup login sidebar rail widget widgets menu navbar nav navigation breadcrumb"
    " breadcrumbs pagination pager masthead footer comment comments commentlist reply replies respond disqus related recommended recommendations toolbar skip".split()
)
NOISE_OUTSIDE = frozenset("header top side search".split())
#: Words that may stand beside those: a name of other words is not the name of such a part.
BESIDE_NOISE = frozenset(
    "area bar block body bottom box btn button buttons center col column container content div element foot form global group header holder icons id in inline inner item items js"
    " label left link links list main module page panel post posts primary right row secondary section site slot space stories text thread title top ui unit wrap wrapper zone".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
BLANKS = re.compile(r"\s+")


# Elements whose end tags may be left out, and what ends them.
SCOPES = frozenset("ul ol menu dl table".split())
ITEM_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
RAW_TEXT = frozenset("script style textarea title".split())

NONE, PART, BREAK = 0, 1, 2


@lru_cache(maxsize=4096)
def role(attrs: str, inside: bool) -> int:
    """Whether the attributes name an element as no part of an article (PART), or as a break inside one (BREAK)."""
    found = NONE
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return BREAK
        if name == "style":
            if "display:none" in value.lower().replace(" ", ""):
                return BREAK
        elif name == "role":
            if value.lower() in NOISE_ROLES:
                found = PART
        else:
            for one in value.split():  # the name as a whole must be one of such a part
                words = set(WORDS.findall(CAMEL.sub("-", one).lower()))
                noise = words & (NOISE if inside else NOISE | NOISE_OUTSIDE)
                if noise and words <= noise | BESIDE_NOISE:
                    found = max(found, BREAK if noise <= BREAKS else PART) if found != PART else PART
    return found


Tag = tuple[int, int, str, bool, str]


def page_tags(page: str) -> list[Tag]:
    """(start, end, name, closing, attributes) of the page's tags; what stands in scripts and the like is none."""
    tags, at = [], 0
    while m := TAG.search(page, at):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        closing = bool(m[1] or m[4])
        tags.append((m.start(), at, name, closing, m[3] or m[6] or ""))
        if name in RAW_TEXT and not closing:
            end = _closer(name).search(page, at)
            at = end.start() if end else len(page) if name in ("script", "style") else at
    return tags


@lru_cache(maxsize=64)
def _closer(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def element_ends(tags: list[Tag]) -> dict[int, int]:
    """Where the element of each start tag ends, by the tag's number; elements that are never closed are left out, but for those whose end tags may be."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    items: list[dict[str, int]] = [{}]
    paragraph = -1
    for k, (start, end, name, closing, attrs) in enumerate(tags):
        if paragraph >= 0 and name in BLOCKS:
            ends[paragraph] = end if closing and name == "p" else start
            paragraph = -1
        if not name or name in VOID or attrs.endswith("/"):
            continue
        if name in ITEM_ENDS:
            for x in ITEM_ENDS[name]:
                if (i := items[-1].pop(x, -1)) >= 0:
                    ends[i] = end if closing and x == name else start
            if not closing:
                items[-1][name] = k
        elif name == "p":
            paragraph = -1 if closing else k
        elif not closing:
            opened.setdefault(name, []).append(k)
            if name in SCOPES:
                items.append({})
        elif opened.get(name):
            ends[opened[name].pop()] = end
            if name in SCOPES and len(items) > 1:
                ends |= {i: start for i in items.pop().values()}
    return ends


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters in links, level) of the page's lines; level 2 in an article, 1 in main, 0 elsewhere."""
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked, in_link, article, main, at, k = 0, False, 0, 0, 0, 0
    tags = page_tags(page)
    ends = element_ends(tags)

    def flush(blanks: int = 0) -> None:
        nonlocal linked
        text = BLANKS.sub(" ", html_lib.unescape("".join(parts))).strip()
        level = 2 if article else 1 if main else 0
        lines.extend([(text, min(linked, len(text)), level)] * bool(text) + [("", 0, level)] * blanks)
        parts.clear()
        linked = 0

    while k < len(tags):
        start, after, name, closing, attrs = tags[k]
        if start > at:
            parts.append(page[at:start])
            linked += start - at if in_link else 0
        at = max(at, after)
        if not name:
            if page.startswith("<![CDATA[", start):
                parts.append(html_lib.escape(page[start + 9 : after - 3]))
        elif not closing and name not in VOID and name not in ("html", "body", "article", "main"):
            kind = PART if name in RAW or name in LEFT_OUT and not (name == "header" and article) else role(attrs, article > 0) if attrs else NONE
            end = ends.get(k, -1) if kind else -1
            if kind and end < 0 and name in RAW_TEXT | {"head"}:  # never closed
                body = page.lower().find("<body", after)
                end = len(page) if name in ("script", "style") else body
            if end >= 0:
                if name in BLOCKS or name in LEFT_OUT:
                    flush(1 if kind == BREAK else WINDOW)
                while k < len(tags) and tags[k][0] < end:
                    k += 1
                at = end
                continue
        k += 1
        if name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = not closing
        elif name in BLOCKS:
            flush(WINDOW if name in ("article", "main") and closing else 0)
            in_link = False
            step = -1 if closing else 1
            if name == "article":
                article = max(0, article + step)
            elif name == "main":
                main = max(0, main + step)
            if name in ("article", "main") and not closing:
                flush(WINDOW)
    parts.append(page[at:])
    flush()
    return lines


def weights(lines: list[tuple[str, int, int]]) -> list[float]:
    """Weighed length of each line."""
    level = max((x[2] for x in lines if x[0]), default=0)

    def weight(text: str, linked: int, own: int) -> float:
        if own < 2 and linked >= LINKED * max(len(text), 1):
            return 0.0
        return len(text) * (BESIDE if own < level else INSIDE if own == 2 else 1.0)

    return [weight(*x) for x in lines]


def kept_lines(lens: list[float], window: int, surge: float) -> list[int]:
    """Numbers of the lines from each surge to the next dive; without a surge, of the stretch between dives that weighs most."""
    head = [0.0]
    for x in lens:
        head.append(head[-1] + x)
    sums = [head[min(i + window, len(lens))] - head[i] if any(lens[i : i + window]) else 0.0 for i in range(len(lens))]
    kept, stretch, stretches, inside = [], [], [], False
    for i, x in enumerate(lens):
        if not sums[i]:
            inside = False
            if stretch:
                stretches.append(stretch)
            stretch = []
        elif x:
            inside = inside or sums[i] >= surge
            stretch.append(i)
            if inside:
                kept.append(i)
    stretches += [stretch] if stretch else []
    return kept or max(stretches, key=lambda s: sum(lens[i] for i in s), default=[])


def main_text(page: str | None) -> str:
    """Article text of one page; empty if it has none."""
    lines = page_lines(page) if page else []
    return " ".join(lines[i][0] for i in kept_lines(weights(lines), WINDOW, SURGE))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a null, empty or textless page has the empty text.

    Repeated rows come back one by one, ids and urls as they are, nulls too; an empty table gives an empty result. Other columns are not
    read. Pages are independent, so there is no shuffle and one long page costs only its own time, which grows with its length.
    Of stretches that tie as the densest, the first is taken.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(work, "page_id long, url string, text string, n_chars long")
