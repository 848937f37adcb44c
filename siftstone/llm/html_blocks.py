"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. What stands in menus, headers, footers, sidebars, dialogs, forms, hidden elements, scripts or
styles, and in containers named as reader comments, is no block at all. Pass one decides blocks by length, stop-word density
and link density: long ones with stop words are in, those mostly of links are out, the rest is ambiguous. Structure is a prior that shifts the limits of
this: in an article or main element whose text is dense, fewer words will do and links alone don't put a block out; outside of it, and in containers named as
adverts, notices or the like, only long blocks of prose are in, and short ones are out. Pass two gives ambiguous blocks the label of their nearest decided
neighbours. Kept blocks, their character references decoded and white space made single spaces, are joined in page order by blank lines.

Nulls: a null html is an empty page and gives an empty text. Broken markup is read as far as it can be: unclosed
tags end with their parents, stray end tags are ignored, an unclosed script hides the rest. Long pages are read
whole in linear time. Blocks as near to a block that is in as to one that is out are in. Repeated rows give repeated results;
an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.llm.common import pieces, released

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUT = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "object", "canvas", "audio", "video", "datalist", "fieldset"}
MAIN = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: A name in class or id marks a container of what isn't the article if it is made of CUES and FRAMES only.
CUES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal",
    "newsletter", "subscribe", "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "social", "share", "sharing", "related", "recommended", "pagination", "masthead",
}
COMMENT_CUES = {"comment", "comments", "disqus", "respond", "replies"}
FRAMES = {
    "area", "list", "box", "section", "wrapper", "wrap", "container", "widget", "bar", "block", "banner", "panel", "inner", "outer", "top", "bottom", "left", "right", "page", "site", "global", "primary", "secondary", "main",
    "sticky", "fixed", "mobile", "desktop", "thread", "form", "link", "links", "button", "buttons", "icons", "item", "items", "unit", "slot", "zone", "posts", "articles", "stories", "message", "overlay", "bottom", "media", "js", "id",
}
#: Containers of these may hold articles of their own: none of them is the page's.
OTHER_ARTICLES = {"related", "recommended", "sponsor", "sponsored", "promo", "promotion"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Why an element is out: its name alone (a prior), or for good.
BY_NAME, FOR_GOOD = 1, 2
STOP_WORDS = frozenset(
    "the of and to in is that it was for on are as with be at by this have from or an not "
    "le la les de des du un une et est en que qui dans pour pas sur au avec par ce "
    "der die das und ist von zu den mit ein eine im nicht auf für dem des sich auch es "
    "el los las y que en un una por con para se del no es al lo como".split()
)


class Limits(NamedTuple):
    """What decides a block, by the place where it stands. A block with over max_links of its characters in links is out; one of at least `long` words, or of
    `short` words of which min_stops are stop words, is in, but if half of it is links; others are ambiguous, or out where `few_out` is set."""

    long: int
    short: int
    min_stops: float
    max_links: float
    few_out: bool


HALF_LINKS = 0.5
#: No article is known; in the page's article; outside of it, or in containers named as adverts, notices or the like.
PLAIN, FAVOURED, DISFAVOURED = Limits(25, 8, 0.15, HALF_LINKS, False), Limits(10, 4, 0.1, 1.0, False), Limits(150, 100, 0.3, 0.1, True)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


@functools.lru_cache(maxsize=10_000)
def cues(names: str, in_main: bool) -> frozenset[str]:
    """The cues of names (the values of class and id) that are made of cues and frames only; in an article no header is one."""
    found: set[str] = set()
    for name in names.split():
        parts = {x.lower() for x in PART.findall(name) if not x.isdigit()}
        marks = {x for x in parts if x in CUES or x in COMMENT_CUES or (x == "header" and not in_main)}
        if marks and parts - marks <= FRAMES:
            found |= marks
    return frozenset(found)


def _is_out(name: str, raw: str, in_main: bool) -> int:
    """0, BY_NAME or FOR_GOOD."""
    if name in OUT or (name == "header" and not in_main):
        return FOR_GOOD
    if not raw.strip() or name in ("html", "body"):
        return 0
    attrs = _attributes(raw)
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in OUT_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return FOR_GOOD
    if name in HEADINGS:
        return 0
    marks = cues(f"{attrs.get('class', '')} {attrs.get('id', '')}", in_main)
    if not marks.isdisjoint(COMMENT_CUES):
        return FOR_GOOD
    if name in MAIN and not in_main:
        return 0
    return 0 if not marks else FOR_GOOD if not marks.isdisjoint(OTHER_ARTICLES) else BY_NAME


class Block(NamedTuple):
    """inside: in an article; links: share of its characters in links; named: in a container named as none of the article."""

    text: str
    inside: bool
    links: float
    tag: str
    named: bool


def blocks(page: str) -> list[Block]:
    """The blocks of a page that structure doesn't rule out for good. Text named as none of the article is a block of its own, after what it stands in."""
    found: list[Block] = []
    # open elements: name, what was out and in an article before it
    stack: list[tuple[str, int, bool]] = []
    opened: Counter[str] = Counter()
    out, in_main, links, tag = 0, False, 0, "body"
    # texts and linked characters of the block, by what `out` is
    parts: tuple[list[str], list[str]] = ([], [])
    linked = [0, 0]

    def flush() -> None:
        for named in (0, BY_NAME):
            if parts[named]:
                text = " ".join("".join(parts[named]).split())
                if text:
                    found.append(Block(text, in_main, min(1.0, linked[named] / len(text)), tag, named == BY_NAME))
                parts[named].clear()
            linked[named] = 0

    def say(text: str) -> None:
        if out != FOR_GOOD and text:
            text = html.unescape(text) if "&" in text else text
            parts[out].append(text)
            if links:
                linked[out] += len(text)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        closing, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not raw.endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name == "br":
            say(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in BLOCK:
            flush()
        if name in VOID or raw.endswith("/") and name not in BLOCK:
            continue
        if closing:
            if opened[name]:
                while True:
                    gone, out, in_main = stack.pop()
                    opened[gone] -= 1
                    if gone == name:
                        break
                links = 0 if name in BLOCK else links
                tag = "body"
        elif name in BLOCK or name in OUT or opened[name] or "class" in raw or "id" in raw or "role" in raw or "hidden" in raw or "style" in raw:
            if name in ("p", "li", "option", "dt", "dd") and stack and stack[-1][0] == name:
                gone, out, in_main = stack.pop()
                opened[gone] -= 1
            stack.append((name, out, in_main))
            opened[name] += 1
            out = 0 if out == BY_NAME and name in MAIN and not in_main else out
            out = max(out, _is_out(name, raw, in_main))
            in_main = in_main or name in MAIN or 'role="main"' in raw or "articleBody" in raw
            tag = name if name in BLOCK else tag
    flush()
    return found


def density(block: Block, limits: Limits = PLAIN) -> bool | None:
    """In, out, or ambiguous by length, link density and stop-word density."""
    if block.links > limits.max_links:
        return False
    words = block.text.lower().split()
    if len(words) >= limits.short and block.links <= HALF_LINKS:
        if len(words) >= limits.long:
            return True
        stops = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)
        if stops >= limits.min_stops:
            return True
    return False if limits.few_out else None


def _limits(found: list[Block]) -> list[Limits]:
    """Structure as a prior: it shifts limits, and decides nothing by itself. An article counts if it has a block that is in by the plain limits, or if nothing outside has."""
    inside = [b.inside and not b.named for b in found]
    dense = [density(b) for b in found]
    outside = [x for x, b in zip(dense, found, strict=True) if not b.inside and not b.named]
    if any(inside) and (any(x for x, i in zip(dense, inside, strict=True) if i) or not any(outside)):
        return [FAVOURED if i else DISFAVOURED for i in inside]
    if all(b.named for b in found):
        return [PLAIN] * len(found)
    return [DISFAVOURED if b.named else PLAIN for b in found]


def main_text(page: str | None) -> str:
    """Pass one decides blocks by density and the limits of their place; in pass two ambiguous ones inherit from their nearest decided neighbours in such a place."""
    found = blocks(page or "")
    limits = _limits(found)
    labels = [density(b, l) for b, l in zip(found, limits, strict=True)]
    open_ = [i for i, l in enumerate(limits) if not l.few_out]
    for i, label in zip(open_, _inherited([labels[i] for i in open_], [found[i].tag for i in open_]), strict=True):
        labels[i] = label
    return "\n\n".join(b.text for b, keep in zip(found, labels, strict=True) if keep)


def _inherited(labels: list[bool | None], tags: list[str]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided one; at equal distance in wins; headings look ahead only."""
    if None not in labels:
        return labels  # type: ignore[return-value]
    n, far = len(labels), len(labels) + 1
    before: list[tuple[int, bool]] = []
    last: tuple[int, bool] = (-far, True)
    for i, x in enumerate(labels):
        last = (i, x) if x is not None else last
        before.append(last)
    after: list[tuple[int, bool]] = [(2 * far, True)] * n
    last = (2 * far, True)
    for i in range(n - 1, -1, -1):
        last = (i, labels[i]) if labels[i] is not None else last  # type: ignore[assignment]
        after[i] = last
    out: list[bool] = []
    for i, x in enumerate(labels):
        if x is not None:
            out.append(x)
            continue
        (p, up), (q, down) = before[i], after[i]
        if tags[i] in HEADINGS and q < far:
            out.append(down)
        elif up == down or i - p == q - i:
            out.append(up or down)
        else:
            out.append(up if i - p < q - i else down)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""

    def run(batches):
        for batch in pieces(batches):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(released(run), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
