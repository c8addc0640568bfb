"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page is cut into blocks, the runs of text between block-level tags. A linear classifier over a block's length, link
density, place and cue words gives the cost of calling it content or boilerplate (terminal capacities); neighbouring
blocks and consecutive blocks of one container are tied by smoothness edges whose weight falls with their distance in
the tree, and a heading to the block that it heads. The minimum cut separates content from boilerplate, and the content
blocks are joined in page order.

Character references are decoded, white space (as Unicode defines it) inside a block becomes one space. Defined cases: null
html is empty; a page without content blocks gives an empty text; text outside any tag is a block; unclosed tags end with
their container or the page (noscript, template, iframe and svg are dropped only if closed); a tag that no ``>`` outside
quotes ends is text; tags that never opened are ignored; repeated rows are extracted row by row; an empty table gives an
empty result. Whole pages are read, nothing is capped: memory and time grow in proportion to the page, however deep its
elements lie and however many tags, quotes or comments stay open.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_metrics.llm.max_flow import least_cost_labels

# What a "<" may open: a comment, a tag, or a declaration.
_OPENING = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
_SPECIAL = re.compile("[>\"']")
# Raw-text elements are dropped whole, to the end of the page if never closed.
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("script", "style", "textarea", "title")}
# One attribute as name and value, or a quoted string that belongs to none.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|\"[^\"]*\"|'[^']*'")
_CLOSED_WHOLE = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("noscript", "template", "iframe", "svg")}  # dropped if closed

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_MATH = set("math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
            "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
              "strike strong sub sup time tt u var wbr img object svg".split()) | _MATH
_ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
_HOLDS = set("ul ol dl table body article section div main td th blockquote aside nav form".split())  # no implied end reaches past these
_ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
              "pre section table ul".split())

_MAIN_TAGS = {"article", "main"}
_NO_OTHER_CUES = {"html", "body"} | _MAIN_TAGS  # a cue word on these tells of the page, not of their text
_MAIN_CUES = set("article articlebody articletext main maincontent post postbody entry story content".split())
_OTHER_TAGS = set("nav footer aside form menu dialog button select fieldset datalist".split())
_OTHER_CUES = set(
    "ad ads adv advert advertisement adsense banner breadcrumb breadcrumbs captcha comment comments commentlist complementary "
    "consent contentinfo cookie cookies dialog discussion disqus footer footnav gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notification pager pagination popup promo promoted promotion related replies reply respond "
    "search share sharing shoutbox sidebar signup skyscraper social sponsor sponsored subscribe tagcloud toolbar tooltip topbar "
    "tracking trackback widget widgets".split())
_HEADER = {"header", "banner"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FINE_PRINT = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|terms of (?:use|service)|privacy policy", re.IGNORECASE)

# Classifier weights in hundredths; the sum is positive for content.
BIAS = -50
PER_WORD, MOST_WORDS = 10, 40
LINKED = -600
IN_MAIN = 700
OUTSIDE_MAIN = -400  # on a page that has a main container
BOILERPLATE = -1500
PAGE_HEADER = -900
FINE_PRINT = -300
HEADING = 100
PER_SENTENCE, MOST_SENTENCES = 50, 4
# Smoothness, falling with the number of tree steps between two blocks.
NEIGHBOUR, CONTAINER = 120, 60
HEADS = 120  # more between a heading and the block after it


class Block(NamedTuple):
    text: str
    element: int  # the innermost open element that is not inline; 0 is the page
    linked: float  # share of characters inside links
    main: bool
    boilerplate: bool
    header: bool
    heading: bool


class _Open(NamedTuple):
    tag: str
    element: int  # its own number, or for an inline element that of the element around it
    heading: bool  # that element is a heading
    main: bool
    boilerplate: bool
    header: bool


_PAGE = _Open("", 0, False, False, False, False)


class Elements:
    """The tree of elements that are not inline: parent and depth by number, one entry each."""

    def __init__(self):
        self.parent, self.depth = [0], [0]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def steps(self, a: int, b: int) -> int:
        """Tree distance. Blocks follow each other as the tree is walked, so over a page these climbs add up to its size."""
        n = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            n += 1
        return n


class _TagEnds:
    """Where the tags of a page end: at the first ``>`` that is not quoted.

    A quote that opens in a tag may lead far, and to nothing. Places outside quotes from which no end is found are
    remembered, so that no part of the page is searched again for every tag before it.
    """

    def __init__(self, page: str):
        self.page, self.fails, self.known = page, set(), (0, -1)

    def _special(self, at: int) -> int:
        start, found = self.known
        if not start <= at <= found:
            m = _SPECIAL.search(self.page, at)
            found = m.start() if m else len(self.page)
            self.known = at, found
        return found

    def find(self, at: int) -> int:
        """The place of the ``>``, or -1."""
        seen = []
        while True:
            at = self._special(at)
            if at < len(self.page) and at not in self.fails:
                sign = self.page[at]
                if sign == ">":
                    return at
                seen.append(at)
                at = self.page.find(sign, at + 1) + 1
                if at:
                    continue
            self.fails.update(seen)
            return -1


def _cues(attributes: str) -> tuple[set[str], bool]:
    words, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name in ("class", "id", "role", "itemprop"):
            words.update(re.split(r"[^a-z0-9]+", value))
    return words, hidden


def page_blocks(page: str) -> list[Block]:
    return page_tree(page)[0]


def page_tree(page: str) -> tuple[list[Block], Elements]:
    """The blocks of a page and the elements that they lie in."""
    blocks: list[Block] = []
    elements = Elements()
    stack: list[_Open] = [_PAGE]
    at_tag: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    holds: list[int] = []  # places of the elements that no implied end reaches past
    parts: list[str] = []
    linked, at = 0, 0
    ends, last_end = _TagEnds(page), page.rfind(">")
    never_closed: set[str] = set()

    def flush():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack[-1]
            blocks.append(Block(text, top.element, min(1.0, linked / len(text)), top.main, top.boilerplate,
                                top.header and not top.main, top.heading))
        parts, linked = [], 0

    def close(upto: int):
        while len(stack) > upto:
            tag = stack.pop().tag
            at_tag[tag].pop()
            if tag in _HOLDS:
                holds.pop()

    def say(upto: int):
        nonlocal linked, at
        parts.append(page[at:upto])
        if at_tag["a"]:
            linked += upto - at
        at = upto

    while at < len(page):
        m = _OPENING.match(page, at)
        if not m:
            upto = page.find("<", at + 1)
            say(upto if upto >= 0 else len(page))
            continue
        if m[1]:
            upto = page.find("-->", m.end())
            at = upto + 3 if upto >= 0 else len(page)
            continue
        if not m[3]:
            upto = page.find(">", m.end()) if m.end() <= last_end else -1
            at = upto + 1 if upto >= 0 else len(page)
            continue
        tag = m[3].lower()
        if not m[2] and tag in _RAW and m.end() <= last_end and (page[m.end()].isspace() or page[m.end()] in "/>"):
            end = _RAW[tag].search(page, page.find(">", m.end()) + 1)
            at = end.end() if end else len(page)
            continue
        upto = ends.find(m.end()) if m.end() <= last_end else -1
        if upto < 0:
            if m[2]:
                upto = page.find(">", m.end()) if m.end() <= last_end else -1
                at = upto + 1 if upto >= 0 else len(page)
            else:
                say(at + 1)
            continue
        attributes, at = page[m.end():upto], upto + 1
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if m[2]:
            if at_tag[tag]:
                if tag not in _INLINE:
                    flush()
                close(at_tag[tag][-1])
            continue
        if tag in _CLOSED_WHOLE and tag not in never_closed and not (tag == "svg" and attributes.endswith("/")):
            if end := _CLOSED_WHOLE[tag].search(page, at):
                at = end.end()
                continue
            never_closed.add(tag)
        if tag not in _INLINE:
            flush()
            ended = max((at_tag[t][-1] for t in _ENDS_ITSELF.get(tag, {"p"} if tag in _ENDS_P else ()) if at_tag[t]), default=0)
            if ended and ended >= (holds[-1] if holds else 0):
                close(ended)
        if attributes.endswith("/"):
            continue
        words, hidden = _cues(attributes) if attributes else (set(), False)
        up = stack[-1]
        if tag in _NO_OTHER_CUES:
            words &= _MAIN_CUES
        other = hidden or tag in _OTHER_TAGS or bool(words & _OTHER_CUES - _HEADER)
        inline = tag in _INLINE
        at_tag[tag].append(len(stack))
        if tag in _HOLDS:
            holds.append(len(stack))
        stack.append(_Open(tag, up.element if inline else elements.add(up.element), up.heading if inline else tag in _HEADINGS,
                           up.main or tag in _MAIN_TAGS or bool(words & _MAIN_CUES), up.boilerplate or other,
                           up.header or tag == "header" or bool(words & _HEADER)))
    flush()
    return blocks, elements


def block_scores(blocks: list[Block]) -> list[int]:
    has_main = any(b.main and not b.boilerplate for b in blocks)
    out = []
    for b in blocks:
        words, ends = len(b.text.split()), len(re.findall(r"[.!?…。](?:\s|$)", b.text))
        out.append(round(
            BIAS + PER_WORD * min(words, MOST_WORDS) + LINKED * b.linked + PER_SENTENCE * min(ends, MOST_SENTENCES)
            + (IN_MAIN if b.main else OUTSIDE_MAIN if has_main else 0) + (BOILERPLATE if b.boilerplate else 0)
            + (PAGE_HEADER if b.header else 0) + (HEADING if b.heading else 0)
            + (FINE_PRINT if not b.main and _FINE_PRINT.search(b.text) else 0)))
    return out


def block_edges(blocks: list[Block], elements: Elements) -> list[tuple[int, int, int]]:
    edges, last_in = [], {}
    for i, b in enumerate(blocks):
        if i:
            heads = HEADS if blocks[i - 1].heading else 0
            edges.append((i - 1, i, NEIGHBOUR // (1 + elements.steps(blocks[i - 1].element, b.element)) + heads))
        container = elements.parent[b.element]
        if container in last_in:
            edges.append((last_in[container], i, CONTAINER))
        last_in[container] = i
    return edges


def main_text(page: str | None) -> str:
    blocks, elements = page_tree(page or "")
    labels = least_cost_labels(block_scores(blocks), block_edges(blocks, elements))
    return " ".join(b.text for b, content in zip(blocks, labels) if content)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""

    @F.pandas_udf("string")
    def text(html_column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in html_column], dtype=object)

    out = pages.select("page_id", "url", text(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
