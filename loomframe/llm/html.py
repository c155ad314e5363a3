"""Main text of web pages: the maximum-scoring run of words and tags.

Words score by where they stand and tags by their name, both as log-odds of lying in the main text, counted on labelled pages. One
linear scan finds the contiguous region with the largest sum. Inside it, subtrees that are never main text (menus, adverts, forms,
comments and so on, known by element or by class, id and role) score nothing and are left out, so they do not cut the region.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose whole content is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "annotation-xml", "annotation", "iframe", "object", "canvas", "select"}
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, slash, name, attributes) of the tags of a page, in time linear in its length; comments, declarations and whole raw
    elements have no name.

    A quote inside a tag runs to its end, so a ">" in it closes nothing. Where that leaves a tag open to the end of the page, quotes
    are not trusted from there on, and the next ">" closes. Without any further ">" the rest is text.
    """
    at, last, quotes = 0, source.rfind(">"), True
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
            yield at, end, "", "", ""
            at = end
            continue
        m = _NAME.match(source, at + 1)
        if not m and source[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        if at > last:
            return
        if not m:
            end = source.index(">", at) + 1
            yield at, end, "", "", ""
            at = end
            continue
        found = _ATTRIBUTES.match(source, m.end()) if quotes else None
        quotes &= found is not None
        if found is None and m.end() > last:
            return
        end = found.end() if found else source.index(">", m.end()) + 1
        name, attributes = m[2].lower(), source[m.end() : end - 1]
        if name in RAW and not m[1] and not _CLOSED.search(attributes):
            stop = _RAW_END[name].search(source, end)
            end = stop.end() if stop else len(source)
            name = ""
        yield at, end, m[1], name, attributes
        at = end


_NAMED = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_BLANK = re.compile(r"[ \t\n\r\f\v\xa0]+")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table",
    "tbody", "tfoot", "thead", "tr", "ul",
}
#: Elements that an opening block ends when they are still open.
CLOSED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
HOLDERS = {"article", "main"}
ASIDE = {"nav", "aside", "footer", "form", "menu", "dialog", "search", "button", "fieldset"}
#: Parts of class, id and role names that mark what is not main text.
ASIDE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
    "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "share", "sharing", "social", "related", "recommended", "comment", "comments", "reply", "replies",
    "disqus", "respond", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "widget", "pagination", "pager", "toolbar", "copyright", "skip", "masthead",
    "complementary", "contentinfo", "search",
}
#: Names that overrule the list above.
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "main", "body"}
#: Class names of elements that are main text or hold it, and of elements that never are: what the parts of a name are judged by.
MAIN_NAMES = (
    "article", "article-body", "article-content", "post-content", "post-body", "post-text", "entry-content", "entry", "content", "content-area", "content-body", "content-container", "main", "main-content", "page-content",
    "page-body", "story", "story-body", "story-text", "text", "text-container", "container", "page-container", "wrapper", "content-wrapper", "inner", "row", "section", "widget-container", "widget-content", "widget-text",
    "modal-free-body", "free-text", "article-comments-count", "comments-count", "article-text",
)
ASIDE_NAMES = (
    *sorted(ASIDE_WORDS), "ad-slot", "ad-container", "ads-wrapper", "advert-content", "banner-content", "cookie-notice", "cookie-content", "cookie-container", "consent-wrapper", "comment-list", "comment-body", "comment-content", "comment-text",
    "comment-wrapper", "comments-area", "comments-container", "comments-wrapper", "article-comments", "post-comments", "story-comments", "content-comments", "entry-comments", "sidebar-widget", "widget-area", "widget-title", "footer-widget",
    "widgets", "sidebar-content", "sidebar-container", "nav-container", "nav-wrapper", "menu-container", "footer-content", "footer-container", "footer-inner", "newsletter-container", "newsletter-content", "modal-content", "modal-body",
    "modal-dialog", "popup-content", "related-posts", "related-content", "related-articles", "article-related", "post-related", "share-container", "social-container", "article-share", "post-share", "promo-content", "search-container",
    "search-wrapper", "notice-text", "alert-text", "login-container", "article-footer", "post-footer", "post-navigation", "breadcrumb-container", "sponsored-content", "ad-text", "ad-inner",
)
#: Names with these tell of another element (no-sidebar, has-comments), not of this one.
ABOUT_WORDS = {"no", "has", "with", "without", "layout"}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_HEADING = re.compile(r"\s*<(h[1-6])(?=[\s>])[^>]*>((?:[^<]|<(?!/?h[1-6]))*+)</\1", re.I)


def _name_parts(name: str) -> list[str]:
    return [x.lower() for x in _PART.findall(name)]


@lru_cache
def name_odds() -> dict[str, float]:
    """Log-odds of a part of a name that the element is aside, counted on the labelled names."""
    counts: dict[str, list[int]] = {}
    for k, names in enumerate((ASIDE_NAMES, MAIN_NAMES)):
        for name in names:
            for x in set(_name_parts(name)):
                counts.setdefault(x, [0, 0])[k] += 1
    return {x: math.log((a + 0.5) / (m + 0.5)) for x, (a, m) in counts.items()}


@lru_cache(maxsize=1 << 16)
def aside_name(name: str) -> bool:
    """Whether a class, id or role tells that the element is never main text: it has a listed part, speaks of no other element, and its
    parts together are likelier aside."""
    parts, odds = _name_parts(name), name_odds()
    return any(x in ASIDE_WORDS for x in parts) and not any(x in ABOUT_WORDS for x in parts) and not (parts[-1] in CONTENT_WORDS and parts[0] in CONTENT_WORDS) and sum(odds.get(x, 0.0) for x in parts) > 0


def _slug(text: str) -> str:
    return "-".join(re.findall(r"[^\W_]+", html.unescape(re.sub(r"<[^>]*>", "", text)).lower()))


def _is_aside(tag: str, attributes: str, depth_in_holder: int, source: str = "", at: int = 0, names: bool = True) -> bool:
    """``source`` from ``at`` on is what the element holds. An id or aria-label inside a holder, of a section, or made from the heading
    that follows counts only if all its words are listed; a heading is never aside by its name."""
    if tag in ASIDE or tag == "header" and not depth_in_holder:
        return True
    if not attributes or tag in ("body", "html"):
        return False
    if _HIDDEN.search(attributes):
        return True
    if tag in HOLDERS and "comment" not in attributes.lower():
        return False
    if tag in HEADINGS or not names:
        return False
    for m in _NAMED.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind in ("id", "aria-label") and not all(x.lower() in ASIDE_WORDS for x in _PART.findall(value)):
            first = _HEADING.match(source, at)
            if depth_in_holder or tag == "section" or first and _slug(first[2]) == _slug(value):
                continue
        if any(map(aside_name, value.split())):
            return True
    return False


class Page:
    """The page as a sequence: blocks of text with their word class, and the tags between them."""

    def __init__(self, source: str, names: bool = True):
        """``names``: whether classes, ids and roles tell what is aside, or elements alone."""
        self.names = names
        #: ("tag", name), ("held", name) for a tag inside a holder, or ("text", index into blocks)
        self.events: list[tuple[str, object]] = []
        #: [pieces of text, words in links, words not in links, inside a holder]
        self.blocks: list[list] = []
        self.held = False
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, bool, bool]] = []  # name, aside from here on, counts as holder
        places: dict[str, list[int]] = {}  # where in the stack a name is open
        blocks: list[int] = []  # where blocks are
        aside = holders = links = 0
        text: list[str] = []
        in_link = in_text = 0

        def flush() -> None:
            nonlocal text, in_link, in_text
            joined = _BLANK.sub(" ", html.unescape("".join(text))).strip(" ")
            if joined:
                self.events.append(("text", len(self.blocks)))
                self.blocks.append([joined, in_link, in_text, holders > 0])
            text, in_link, in_text = [], 0, 0

        def add(raw: str) -> None:
            nonlocal in_link, in_text
            if aside or not raw:
                return
            text.append(raw)
            n = len(raw.split())
            if links:
                in_link += n
            else:
                in_text += n

        def close(to: int) -> None:
            nonlocal aside, holders, links
            while len(stack) > to:
                name, was_aside, holder = stack.pop()
                places[name].pop()
                if name in BLOCKS:
                    blocks.pop()
                    flush()
                aside -= was_aside
                holders -= holder
                links -= name == "a"

        at = 0
        for begin, end, slash, name, attributes in tags(source):
            add(source[at:begin])
            at = end
            if not name:
                continue
            if slash:
                at_open = places[name][-1] if places.get(name) else None
                if at_open is None or name not in BLOCKS and blocks and blocks[-1] > at_open:
                    if name in BLOCKS:
                        flush()
                    continue
                close(at_open)
                if not aside:
                    self.events.append(("held" if holders else "tag", name))
                continue
            if name in BLOCKS:
                flush()
                if blocks and (stack[blocks[-1]][0] in CLOSED_BY_BLOCK or name == "li" and stack[blocks[-1]][0] == "li"):
                    close(blocks[-1])
            elif name in ("br", "td", "th", "img", "input"):
                add(" ")
            if not aside:
                self.events.append(("held" if holders else "tag", name))
            if name in VOID or _CLOSED.search(attributes):
                continue
            off = _is_aside(name, attributes, holders, source, at, self.names)
            holder = name in HOLDERS and not off and not aside
            self.held |= holder
            places.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append((name, off, holder))
            aside += off
            holders += holder
            links += name == "a"
        add(source[at:])
        close(0)
        flush()

    def word_class(self, block: list) -> str:
        return "held" if block[3] else "loose" if self.held else "plain"


# --- weights -----------------------------------------------------------------------------------------------------

_SPACES = "the page holds a text of some length and it goes on for a while so that words outnumber the tags around them".split()


def labelled_pages() -> Iterator[tuple[str, set[str]]]:
    """Pages in the usual layouts with the texts of their main blocks, made by rule."""

    def words(n: int, mark: str) -> str:
        return " ".join(f"{w}{mark}" if k == 0 else w for k, w in enumerate(itertools.islice(itertools.cycle(_SPACES), n)))

    serial = itertools.count()
    for layout, shape, length in itertools.product(("article", "main", "div", "section", "table"), range(8), (6, 25, 70)):
        mark = f"q{next(serial)}"
        body = [words(5, f"{mark}h"), *(words(length + 7 * k, f"{mark}p{k}") for k in range(2 + shape))]
        inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{x}</p>" if k % 3 else f"<p><b>{x}</b><br></p>" for k, x in enumerate(body[1:]))
        if shape == 1:
            body.append(words(9, f"{mark}l"))
            inner += f"<ul><li>{body[-1]}</li></ul>"
        if shape == 2:
            body.append(words(14, f"{mark}c"))
            inner += f"<blockquote><p>{body[-1]}</p></blockquote>"
        if shape == 4:
            body.append(words(40, f"{mark}i"))
            inner += "<p>" + " ".join(f'<a href="/{k}">{w}</a>' if k % 8 == 4 else w for k, w in enumerate(body[-1].split())) + "</p>"
        if shape == 5:
            cells = [f"{mark}{k}" for k in range(12)]
            body += cells
            inner += "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(cells[::2], cells[1::2], strict=True)) + f"</table><p>{words(20, mark + 'e')}</p>"
            body.append(words(20, f"{mark}e"))
        if shape == 6:
            items = [words(3, f"{mark}j{k}") for k in range(8)]
            body += items
            inner += "<ul>" + "".join(f'<li><a href="/{k}">{x}</a></li>' for k, x in enumerate(items)) + f"</ul><p>{words(20, mark + 'e')}</p>"
            body.append(words(20, f"{mark}e"))
        if shape == 7:
            items = [f"{mark}w{k}" for k in range(48)]
            body += items
            inner += "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        links = lambda n, m: "<ul>" + "".join(f'<li><a href="/{k}">{words(2, f"{m}{k}")}</a></li>' for k in range(n)) + "</ul>"
        menu = f"<div>{links(6, mark + 'm')}</div>"
        low = f"<div><p>{words(8, mark + 'f')}</p>{links(4, mark + 'g')}</div>"
        side = f"<div><h3>{words(2, mark + 's')}</h3>{links(5, mark + 't')}</div>"
        core = {"article": f"<article>{inner}</article>", "main": f"<main>{inner}</main>", "div": f'<div id="content">{inner}</div>', "section": f"<section>{inner}</section>", "table": f"<table><tr><td>{inner}</td></tr></table>"}[layout]
        yield f"<html><body>{menu}{side if shape % 2 else ''}{core}{low}</body></html>", set(body)


@lru_cache
def weights() -> dict[str, float]:
    """Score of each word class and tag: log-odds of lying in the main text, words at least a little above and tags below zero."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for source, body in labelled_pages():
        page = Page(source)
        own = [k for k, (kind, x) in enumerate(page.events) if kind == "text" and page.blocks[x][0] in body]
        for k, (kind, x) in enumerate(page.events):
            to = inside if own[0] <= k <= own[-1] else outside
            if kind != "text":
                to[f"<{x}>"] += 1
            else:
                block = page.blocks[x]
                to["link"] += block[1]
                to[page.word_class(block)] += block[2]
    out = {k: math.log((inside[k] + 0.5) / (outside[k] + 0.5)) for k in inside | outside}
    for k in out:
        if k.startswith("<"):
            out[k] = min(-0.05, out[k] - 1)
    return out | {"held": max(out["held"], 1.0), "plain": max(out["plain"], 0.5), "loose": min(out.get("loose", -1.0), -0.5), "link": min(out["link"], -0.2), "other": -0.3}


def main_text(source: str | None) -> str:
    """The main text of one page; empty if there is none."""
    if not source:
        return ""
    score = weights()
    page = Page(source)
    if not page.blocks:  # a wrapper's name may tell of what it holds beside the text: then elements alone decide
        page = Page(source, names=False)
    best, total, begin, span = 0.0, 0.0, 0, (0, 0)
    for k, (kind, x) in enumerate(page.events):
        if kind == "held":
            continue  # a holder says more than the tags in it
        if kind == "tag":
            total += score.get(f"<{x}>", score["other"])
        else:
            block = page.blocks[x]
            inside = block[3]
            total += block[2] * score[page.word_class(block)] + block[1] * (0.3 if inside else score["link"])
        if total <= 0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, span = total, (begin, k + 1)
    return "\n\n".join(page.blocks[x][0] for kind, x in page.events[slice(*span)] if kind == "text")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(part.column(2)[k].as_py()) for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages(page_id, url, html)``.

    Blocks are joined by an empty line in page order, character references decoded, and white space inside a block made one space. A
    null or empty html, or one without main text, gives an empty text. A page that is broken off or nested without end takes time in
    proportion to its length. Repeated rows and null ids each give their own row; other
    columns are ignored. Whole pages are read; nothing is cut.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
