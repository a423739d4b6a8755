"""Operator 5: main text of web pages by tag-path ratios.

A page is read into text blocks, each with the path of block tags from the root.  Text length and
punctuation are aggregated per path, smoothed along the page and fused into one value per path; paths
above a threshold are content, and what stands in the same container (headings, short paragraphs)
goes with them.  Parts that their tag, role or class names as menus, notices, comments and the like
have no weight, unless only a class, id or form says so and the part holds most of the page's text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values of HTML --------------------------------------------------------------------
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math",
       "object", "canvas", "noframes", "noembed", "xmp")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "wbr", "br")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CLOSES_PARAGRAPH = ("address", "article", "aside", "blockquote", "center", "dd", "details", "div",
                    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", *HEADINGS,
                    "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
                    "table", "ul")
CLOSES_SAME = ("li", "dt", "dd", "option", "tr", "td", "th", "thead", "tbody", "tfoot")
SCOPES = ("ul", "ol", "dl", "table", "select", "menu")
# ---- names of parts that are not the article --------------------------------------------------
ASIDE_TAGS = ("nav", "footer", "aside", "form", "header", "button", "select", "menu", "dialog",
              "fieldset", "head", "label", "option")
ASIDE_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog",
               "form", "menu", "menubar", "toolbar", "alertdialog")
ASIDE_WORDS = ("ad", "ads", "advert", "advertisement", "advertising", "adverts", "banner",
               "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie",
               "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "login",
               "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
               "notices", "pagination", "pager", "paywall", "popup", "privacy", "promo", "promoted",
               "promotion", "recommended", "related", "replies", "reply", "respond", "search",
               "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
               "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets")
ARTICLE_WORDS = ("article", "articlebody", "content", "entry", "main", "post", "story")
COMMENT_WORDS = ("comment", "comments", "disqus", "replies", "reply", "respond")
# -----------------------------------------------------------------------------------------------

MOST = 0.5  # of the page's unlinked text: a form or an element of a named class with more is a wrapper
NEARLY_ALL = 0.9  # the same where the name is that of comments, which may outgrow their article
THRESHOLD = 0.25  # of the length-weighted mean value of the page's paths
WINDOW = (0.25, 0.5, 0.25)

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW)})\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[,.;:!?、。，；：！？]")


@dataclass
class Element:
    tag: str
    aside: bool
    article: bool
    masthead: bool = False  # a header of the article: only its headings count
    sure: bool = False  # aside by more than a name or a form
    wrapper: float = 0.0  # share of the text from which its name or form does not count


@dataclass
class Block:
    path: int
    serial: int  # of the element that holds it
    heading: bool
    aside: bool
    article: bool
    sure: bool = False
    text: str = ""
    linked: int = 0


@dataclass
class Page:
    """Blocks in page order and the elements they lie in, each numbered after its parent."""

    blocks: list[Block]
    parents: list[int]
    weak: dict[int, float]  # elements that only a name or a form marks, and the share that frees them

    def sums(self, blocks: list[Block], values: list[int]) -> list[int]:
        """Values of the blocks summed over every element they lie in."""
        held = [0] * len(self.parents)
        for block, value in zip(blocks, values):
            held[block.serial] += value
        for serial in range(len(held) - 1, 0, -1):
            held[self.parents[serial]] += held[serial]
        return held


def attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag in lower case; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), "".join(values))
    return found


def element(tag: str, rest: str, parent: Element, wraps: bool = False) -> tuple[Element, str]:
    """The element, and its step of the tag path: tag and first names."""
    given = attributes(rest) if rest.strip(" /") else {}
    role = given.get("role", "").strip().lower()
    marked = " ".join(given[name] for name in ("class", "id", "role", "itemprop") if name in given)
    names = tuple(w.lower() for w in WORD.findall(marked))
    article = parent.article or tag in ("article", "main") or role in ("article", "main")
    aside_names = {w for w in names if w in ASIDE_WORDS}
    named = bool(aside_names) and tag not in ("body", "html", "article", "main")
    # a header of the article, by its tag or by a name like entry-header
    masthead = (tag == "header" or (named and aside_names <= {"header", "masthead"})) and (
        (parent.article and not parent.aside) or (named and names[0] in ARTICLE_WORDS)
    )
    inherits = not (parent.masthead and tag in HEADINGS)
    hidden = (
        given.get("hidden", "false").lower() != "false"
        or given.get("aria-hidden", "").strip().lower() == "true"
        or bool(NOT_SHOWN.search(given.get("style", "")))
    )
    own = (tag in ASIDE_TAGS and tag != "form") or role in ASIDE_ROLES or hidden
    sure = (parent.sure and inherits) or own
    weak = tag == "form" or named
    aside = (parent.aside and inherits) or own or (weak and not wraps)
    wrapper = 0.0
    if weak and not sure:
        wrapper = NEARLY_ALL if any(w in COMMENT_WORDS for w in names) else MOST
    return Element(tag, aside, article, masthead, sure, wrapper), ".".join((tag, *names[:3]))


def read(source: str) -> Page:
    """Text blocks in page order.  Unclosed tags close as in browsers where that moves text."""
    page = parsed(source, frozenset())
    if page.weak:
        counted = [b for b in page.blocks if not b.sure]
        counted = [b for b in counted if b.article] or counted
        held = page.sums(counted, [max(len(b.text) - b.linked, 0) for b in counted])
        wrappers = frozenset(s for s, share in page.weak.items() if held[0] and held[s] > share * held[0])
        if wrappers:
            page = parsed(source, wrappers)
    return page


def parsed(source: str, wrappers: frozenset[int]) -> Page:
    """The page, ``wrappers`` free of the mark of their name or form.  Work is linear in the page: a
    block knows only the element it lies in, and an element its parent."""
    weak: dict[int, float] = {}
    parents, paths = [0], {}
    stack: list[tuple[Element, int, int]] = [(Element("", False, False), 0, 0)]  # element, serial, path
    opened: dict[str, int] = defaultdict(int)
    link_depth, at = 0, 0
    blocks: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            top, serial, path = stack[-1]
            heading = any(e.tag in HEADINGS for e, _, _ in stack[-2:])
            blocks.append(Block(path, serial, heading, top.aside, top.article, top.sure, text, linked))
        linked = 0

    def drop(depth: int) -> None:
        for dropped, _, _ in stack[depth:]:
            opened[dropped.tag] -= 1
        del stack[depth:]

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if link_depth:
            linked += len(text)

    for token in TOKEN.finditer(source):
        if token.start() > at:
            say(source[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            say(" ")
        elif tag in INLINE:
            if tag == "a":
                link_depth = 0 if token["end"] else 1
        elif token["end"]:
            flush()
            if opened[tag]:
                link_depth = 0
                drop(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0].tag == tag))
        else:
            flush()
            link_depth = 0
            if tag in CLOSES_PARAGRAPH and stack[-1][0].tag in ("p", *HEADINGS):
                drop(len(stack) - 1)
            if tag in CLOSES_SAME and opened[tag]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0].tag in SCOPES:
                        break
                    if stack[depth][0].tag == tag:
                        drop(depth)
                        break
            if tag == "body":  # whatever the head left open
                drop(1)
            if tag not in VOID and not token["rest"].endswith("/"):
                serial = len(parents)
                above, parent, path = stack[-1]
                made, step = element(tag, token["rest"], above, serial in wrappers)
                parents.append(parent)
                opened[tag] += 1
                if made.wrapper:
                    weak[serial] = made.wrapper
                stack.append((made, serial, paths.setdefault((path, step), len(paths) + 1)))
    if at < len(source):
        say(source[at:])
    flush()
    return Page(blocks, parents, weak)


def path_values(blocks: list[Block]) -> dict[int, float]:
    """Fused ratio per tag path: characters and marks per block outside links, smoothed along the
    page so that short blocks amid content gain and single long ones amid boilerplate lose."""
    chars: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    count: dict[int, int] = defaultdict(int)
    for block in blocks:
        own = 0 if block.aside else max(len(block.text) - 2 * block.linked, 0)
        chars[block.path] += own
        marks[block.path] += len(MARKS.findall(block.text)) if own else 0
        count[block.path] += 1
    ratio = {p: chars[p] / count[p] * (1 + marks[p] / count[p]) for p in count}
    along = np.array([ratio[b.path] for b in blocks])
    smooth = np.convolve(np.pad(along, 1, mode="edge"), WINDOW, mode="valid")
    sums: dict[int, float] = defaultdict(float)
    for block, value in zip(blocks, smooth):
        sums[block.path] += value
    return {p: (sums[p] / count[p] * ratio[p]) ** 0.5 for p in count}


def main_text(source: str | None) -> str:
    """The article's blocks, joined by line ends; empty where the page has none.

    Null or empty html gives an empty text.  Nothing of a chosen block is dropped, and time grows with
    the length of the page, however long or deeply nested.
    """
    page = read(source or "")
    blocks = page.blocks
    if any(b.article and not b.aside for b in blocks):
        blocks = [b for b in blocks if b.article]
    if not blocks:
        return ""
    values = path_values(blocks)
    sizes = np.array([0 if b.aside else len(b.text) for b in blocks], float)
    each = np.array([values[b.path] for b in blocks])
    if not sizes.sum():
        return ""
    border = THRESHOLD * (each * sizes).sum() / sizes.sum()
    content = [not b.aside and v >= border and v > 0 for b, v in zip(blocks, each)]
    # the container that holds most of the content: its other plain blocks belong to the article
    weight = page.sums(blocks, [int(size) * chosen for size, chosen in zip(sizes, content)])
    depth, inside, home = [0] * len(weight), [False] * len(weight), 0
    for serial, parent in enumerate(page.parents):
        depth[serial] = depth[parent] + (serial > 0)
        if weight[serial] >= 0.6 * weight[0] and depth[serial] > depth[home]:
            home = serial
    for serial, parent in enumerate(page.parents):
        inside[serial] = serial == home or (serial > 0 and inside[parent])
    kept = []
    for block, chosen in zip(blocks, content):
        plain = not block.aside and 2 * block.linked < max(len(block.text), 1)
        if chosen or (inside[block.serial] and plain) or (block.article and block.heading and plain):
            kept.append(block.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) from ``html``.

    Equal pages get equal texts; every row is kept; columns of these two names are replaced.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    return pages.withColumn("text", texts("html")).withColumn(
        "n_chars", F.char_length("text").cast("bigint")
    )
