"""Main text of web pages by line-block distribution.

1. Markup is stripped to lines, one for each block of text. Scripts, styles, forms, menus
   and other elements that are no article by themselves leave nothing. The start or end
   of a container (such as div) is an empty line; a heading has none behind it. An article
   or main element is one block: there are none inside it, and WINDOW of them at its edges.
2. A line weighs the length of its text. Text of links weighs nothing, nor does a line that
   is half of links, unless it is inside an article or main element. On a page that has such an element, a line outside it weighs
   OUTSIDE of its length, and nothing if its class, id or role marks it as an advert,
   comment, notice or the like. Marked blocks inside the element, or on a page without
   one, are stripped as markup is.
3. Weights are summed over sliding windows of WINDOW lines. A surge point is where the sum
   rises from zero, a dive point where it falls to zero again; so a block of lines ends
   where WINDOW lines without weight follow each other.
4. The text between a surge and its dive is kept if the highest sum there is at least SHARE of
   the page's highest. Every line of it is kept, however short.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.llm import memory, shingles

#: Bytes of pages that a worker handles at a time.
PART = 4_000_000
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Elements whose content is no markup; they are skipped to their end tag.
_RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that never hold main text.
_DROP = {"aside", "button", "canvas", "datalist", "dialog", "embed", "footer", "form", "head", "header", "map", "menu", "nav", "noscript", "object", "select", "svg", "template"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form", "toolbar"}
#: Lines of a window; share of the page's highest sum that a block of lines must reach; weight of a character outside the article.
WINDOW, SHARE, OUTSIDE = 3, 0.2, 1 / 64
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose start and end are an empty line.
_CONTAINERS = {"address", "article", "body", "center", "details", "div", "dl", "dir", "fieldset", "figure", "main", "ol", "section", "table", "ul"}
#: Words of class names and ids that mark what is no main text.
_MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "commentlist", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager",
    "pagination", "popup", "promo", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
#: Words that may stand beside those: a name with any other word marks nothing ("banner-story", "comment-on-law").
_NEUTRAL = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "outer",
    "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "thread", "top", "unit", "user", "wrap", "wrapper",
}
#: Elements that class names don't mark.
_KEEP = {"html", "body", "article", "main"}
_SPLIT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")


@cache
def _ends(name: str) -> re.Pattern:
    return re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)[^>]*+(?:>|\\Z)", re.I)


def _marked(attributes: str) -> bool:
    """Whether class, id or role say that an element holds no main text."""
    if not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if name.lower() == "role":
            if value.strip().lower() in _ROLES:
                return True
            continue
        for one in value.split():
            parts = [x.lower() for x in _SPLIT.split(one) if x and not x.isdigit()]
            if any(x in _MARKS for x in parts) and all(x in _MARKS or x in _NEUTRAL for x in parts):
                return True
    return bool(_HIDDEN.search(attributes))


@dataclass(slots=True)
class Line:
    """A line of a page; an empty one is the edge of a container."""

    text: str
    linked: int  # characters of links
    marked: bool
    inside: bool  # an article or main element


def lines(html: str) -> list[Line]:
    """The page's lines, without those of dropped elements; time grows with the length alone, whatever the nesting."""
    out: list[Line] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, dropped, marked, in an article
    blocks: list[int] = []  # places in the stack of block elements
    count: Counter[str] = Counter()
    dropped = marked = inside = heading = False
    links = 0
    pos, end = 0, len(html)

    def take(piece: str) -> None:
        if not dropped:
            text.append(piece)
            if links:
                linked.append(piece)

    def cut() -> None:
        nonlocal heading
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                out.append(Line(line, len(" ".join(unescape("".join(linked)).split())), marked, inside))
                heading = any(count[e] for e in _HEADINGS)
            text.clear()
            linked.clear()

    def edge(name: str, marked: bool, inside: bool) -> None:
        if name in _CONTAINERS and not dropped and not (heading and name not in ("article", "main")) and out:
            out.extend([Line("", 0, marked, inside)] * (WINDOW if name in ("article", "main") else 1))

    def pop(depth: int) -> None:
        """Ends the element at this depth, and all within it."""
        nonlocal dropped, marked, inside, links
        for name, *_ in stack[depth:]:
            count[name] -= 1
        links = count["a"]
        del stack[depth:]
        while blocks and blocks[-1] >= depth:
            blocks.pop()
        dropped, marked, inside = stack[-1][1:] if stack else (False, False, False)

    while pos < end:
        at = html.find("<", pos)
        m = None
        while at >= 0 and (m := _TOKEN.match(html, at)) is None:
            at = html.find("<", at + 1)
        if at < 0:
            take(html[pos:])
            break
        if at > pos:
            take(html[pos:at])
        pos = m.end()
        if not m[2]:
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name == "br":
            take(" ")
            continue
        if name in _BLOCK or name in _DROP:
            cut()
        if closing:
            if count[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                if (dropped, marked, inside) != (stack[depth - 1][1:] if depth else (False, False, False)):
                    cut()
                was = marked
                pop(depth)
                edge(name, was, inside)
            continue
        if name in _RAW:
            close = _ends(name).search(html, pos)
            pos = close.end() if close else end
            continue
        if name in _VOID:
            continue
        if name in _BLOCK:
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ("p",))
            for depth in blocks[-1:-3:-1]:
                if stack[depth][0] in ends:
                    pop(depth)
                    break
                if stack[depth][0] != "p":
                    break
            if count["head"] and name not in ("html", "head"):
                pop(next(i for i, x in enumerate(stack) if x[0] == "head"))
        before = (dropped, marked, inside)
        here = (dropped or name in _DROP, marked or (name not in _KEEP and _marked(attributes)), inside or name in ("article", "main"))
        edge(name, here[1], inside)
        if here != before:
            cut()
        dropped, marked, inside = here
        stack.append((name, *here))
        if name in _BLOCK:
            blocks.append(len(stack) - 1)
        count[name] += 1
        links = count["a"]
    cut()
    return out


def weighed(found: list[Line]) -> list[tuple[str, float]]:
    """Lines and their weights; what is marked, or the edge of a container, inside the article (or on a page without one) is left out."""
    article = any(x.inside and not x.marked and x.text for x in found)
    plain = lambda x: float(len(x.text) - x.linked) if len(x.text) > 2 * x.linked else 0.0
    out = []
    for x in found:
        if x.inside or not article:
            if x.marked or (x.inside and not x.text):
                continue
            out.append((x.text, float(len(x.text)) if x.inside else plain(x)))
        else:
            out.append((x.text, 0.0 if x.marked else plain(x) * OUTSIDE))
    return out


def between(weights: list[float], window: int = WINDOW, share: float = SHARE) -> list[tuple[int, int]]:
    """(surge, dive): the ranges of lines whose window sums rise from zero and fall to zero, and reach the share of the highest sum between.

    The surge is the first line with a weight in the window whose sum is the first over zero.
    """
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    least = share * max(sums, default=0)
    out, start = [], None
    for i in range(n + 1):
        if i < n and sums[i] > 0:
            start = i if start is None and weights[i] > 0 else start
        elif start is not None:
            if max(sums[start:i]) >= least:
                out.append((start, i))
            start = None
    return out


def main_text(html: str | None) -> str:
    """The page's main text: its lines joined by a line feed; empty for null, and for a page without text or with text of links alone."""
    if not html:
        return ""
    found = weighed(lines(html))
    kept = (found[i][0] for surge, dive in between([w for _, w in found]) for i in range(surge, dive))
    return "\n".join(x for x in kept if x)


def extract(pages: DataFrame) -> DataFrame:
    """A row for each row of pages: page_id, url, text (empty if there is none), n_chars (code points).

    Null html counts as empty; null ids and urls stay; repeated rows are each extracted;
    other columns are not read.
    """

    @memory.lean
    def run(batches):
        for batch in batches:
            at = 0
            for pages in shingles.slices(batch.column(2), PART):
                texts, n = [main_text(h) for h in pages.to_pylist()], len(pages)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                at += n

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_extract_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(storage.table(spark, sf_dir, "pages"))
