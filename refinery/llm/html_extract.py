"""Main text of web pages by shallow text features.

A page is cut into flat text blocks at block-level tags. Menus, footers,
sidebars, forms and the like that their tags, roles or unmistakable class
names give away are left out at once; they stay neighbours of the others. Each
other block has few numbers: words, share of words in links, the same two of
the block before and of the block after, and a little about its container. A
decision tree tells main text from the rest; it is grown here, by Gini
impurity, on a small table of labelled blocks from hand-written pages
(``LABELLED``). The text is the chosen blocks in page order, one to a line.

Class names that can mean many things (``discussion``, ``notice``, ``promo``)
are no more than a feature: how small a part of the page their container is. A
form that holds the page's structure (an article, heading, header and so on)
wraps the page and is no form. Where a page comes out empty it is read again
with all forms as plain containers, and then with unmistakable class names as
a feature only, since such names may be on a container of the whole page; the
first reading with a text counts.

Defined results: character references are decoded, also unterminated ones
that HTML knows; white space inside a block becomes one space; the contents of
head, scripts, styles, forms, comments and embedded objects are no text; tags
that are never closed end with their container; a null or empty page, or one
without main text, gives an empty text; repeated rows come out once each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tune

#: Tags whose content is no text, tags inside a line, containers, tags without content.
SKIPPED = set("head script style template noscript svg math canvas iframe object embed audio video map form select option button textarea input fieldset datalist dialog frameset noframes".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "xmp"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br".split())
CONTAINERS = set("article main nav header footer aside section div ul ol dl table tr td th li menu figure details blockquote center".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Container tags, roles and words of class or id that tell what a container holds.
GOOD_TAGS, BAD_TAGS = {"article", "main"}, {"nav", "aside", "footer", "menu"}
GOOD_ROLES, BAD_ROLES = {"main", "article"}, set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD_WORDS = set("article content main post entry story body text maincontent articlebody".split())
BAD_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription signup login register sidebar share sharing social "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar footer comment comments commentlist disqus popup modal overlay copyright tagcloud outbrain taboola".split()
)
WEAK_WORDS = set(
    "banner promo promotion notice notices notification alert side rail widget widgets related recommended recommendations popular trending foot reply replies respond responses "
    "discussion reviews legal disclaimer tags skip search teaser teasers paywall masthead".split()
)
HEAD_WORDS = {"header", "head", "hdr"}
#: Words that turn a class name into a remark on the page (has-sidebar, no-ads).
REMARKS = {"has", "no", "with", "without", "enabled", "free", "layout"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[^\W_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What shows that a form wraps a page.
STRUCTURE = re.compile(r"<(?:article|main|nav|header|footer|h1)\b", re.I)

PLAIN, GOOD, WEAK, BAD, SKIP = range(5)
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "held", "weak_apart", "heading", "in_list"]


def kind_of(tag: str, attributes: str, in_main: bool, sure: bool = True) -> int:
    """What a container holds: main text, other text, perhaps other text, nothing to show, or unknown.

    Without ``sure``, class names that are unmistakable otherwise are a hint only.
    """
    found = {}
    if "=" in attributes or "hidden" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), value.strip("\"'").lower())
    if "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", "")):
        return SKIP
    role = found.get("role", "")
    if role in BAD_ROLES or tag in BAD_TAGS:
        return BAD
    names: set[str] = set()
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        words = set(re.split(r"[^a-z]+", name))
        if not words & REMARKS:
            names |= words
    if names & BAD_WORDS:
        return BAD if sure else WEAK
    if (tag == "header" or names & HEAD_WORDS) and not in_main and not names & GOOD_WORDS:
        return BAD if tag == "header" or sure else WEAK
    if names & WEAK_WORDS:
        return WEAK
    if role in GOOD_ROLES or tag in GOOD_TAGS or names & GOOD_WORDS:
        return GOOD
    return PLAIN


class Block:
    __slots__ = ("text", "words", "linked", "held_by", "in_main", "weak", "heading", "in_list")

    def __init__(self, text: str, linked: int, held_by: int, in_main: bool, weak: int, heading: bool, in_list: bool):
        self.text, self.held_by, self.in_main, self.weak, self.heading, self.in_list = text, held_by, in_main, weak, heading, in_list
        self.words = len(WORDS.findall(text))
        self.linked = min(linked, self.words)


def blocks(page: str, forms: bool = False, sure: bool = True) -> list[Block]:
    """Flat text blocks in page order; ``forms``: those in forms as well."""
    parts: list[str] = []
    links: list[str] = []
    # container, what it holds, whether main text holds it, number of its outermost weak container
    stack: list[tuple[str, int, bool, int]] = [("", PLAIN, False, 0)]
    weak = 0
    skipping: list[str] = []
    anchor = heading = False
    made: list[Block] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                linked = len(WORDS.findall(html.unescape(" ".join(links)))) if links else 0
                in_list = any(t in ("li", "td", "th") for t, *_ in stack[-3:])
                made.append(Block(text, linked, *stack[-1][1:], heading, in_list))
            parts.clear()
            links.clear()

    at, lower = 0, page.lower()
    opened: Counter[str] = Counter()  # containers on the stack
    # no tag begins after the last >, and looking for one from each < there would take the square of their number
    last, data = page.rfind(">") + 1, page.rfind("]]>")
    while True:
        m = TAG.search(page, at, last) if at < last else None
        piece = page[at : m.start() if m else len(page)]
        if piece and not skipping:
            parts.append(piece)
            if anchor:
                links.append(piece)
        if m is None:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            if m[0] == "<![CDATA[":
                end = page.find("]]>", at) if at <= data else page.find(">", at)
                if at <= data and not skipping:
                    parts.append(page[at:end])
                at = end + (3 if at <= data else 1)
            elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            end = lower.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
            continue  # its closing tag follows, which closes nothing
        if tag == "form" and not skipping and (forms or closing or _wraps(page, lower, at)):
            flush()
            continue
        if tag in SKIPPED or skipping:
            if tag in VOID or attributes.endswith("/"):
                continue
            if closing:
                if tag in skipping:
                    del skipping[len(skipping) - 1 - skipping[::-1].index(tag) :]
                elif skipping and (tag == "body" or tag == "html" or opened[tag]):
                    skipping.clear()  # a form or the like that was never closed ends with its container
                    at = m.start()
            elif tag in SKIPPED:
                flush()
                skipping.append(tag)
            elif tag == "body":
                skipping.clear()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                anchor = not closing
                if anchor and links:
                    links.append(" ")
            continue
        flush()
        anchor = False
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            heading = not closing
        if tag in CONTAINERS:
            heading = False
            if closing:
                while opened[tag]:
                    ended = stack.pop()[0]
                    opened[ended] -= 1
                    if ended == tag:
                        break
            elif not attributes.endswith("/"):
                _, held, in_main, within = stack[-1]
                kind = kind_of(tag, attributes, in_main, sure)
                kind = max(kind, held)  # what is in a sidebar is no main text, whatever it is called
                if kind == WEAK and not within:
                    weak += 1
                    within = weak
                opened[tag] += 1
                stack.append((tag, kind, in_main or kind == GOOD, within))
    flush()
    return made


def _wraps(page: str, lower: str, at: int) -> bool:
    """Whether a form that begins before ``at`` holds the structure of the page."""
    end = lower.find("</form", at)
    return end >= 0 and STRUCTURE.search(page, at, end) is not None


def features(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``FEATURES`` for each block of one page, and whether the tree is to be asked about it."""
    if not found:
        return np.zeros((0, len(FEATURES))), np.zeros(0, bool)
    words = np.array([b.words for b in found], np.float64)
    plain = words - np.array([b.linked for b in found])
    links = np.array([b.linked / b.words if b.words else 0.0 for b in found])
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    asked = np.array([b.held_by < BAD for b in found])
    in_main = np.array([b.held_by == GOOD or b.in_main and b.held_by == PLAIN for b in found])
    within = np.array([b.weak for b in found])
    share = np.bincount(within, weights=plain)[within] / max(1.0, plain.sum())
    apart = np.where(within > 0, 1.0 - share, 0.0)
    # 1 where something is marked as the main text, -1 beside it, 0 on a page that marks nothing
    held = np.where(in_main, 1.0, -1.0 if in_main.any() else 0.0)
    rest = [held, apart, [b.heading for b in found], [b.in_list for b in found]]
    return np.stack([words, links, before(words), before(links), after(words), after(links), *np.array(rest, np.float64)], axis=1), asked


class Tree:
    """A decision tree of axis-parallel cuts, grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, first: tuple[tuple[int, float], ...] = (), depth: int = 6, least: int = 2):
        """``first``: cuts that are made before any that are found."""
        self.cut: tuple[int, float] | None = None
        if first:
            self._split(x, y, first[0], first[1:], depth, least)
            return
        self.value = bool(y.mean() >= 0.5) if len(y) else False
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return
        best = (_gini(y) - 1e-9, None)
        for f in range(x.shape[1]):
            kinds = np.unique(x[:, f])
            for at in (kinds[1:] + kinds[:-1]) / 2:
                left = x[:, f] <= at
                n = int(left.sum())
                if least <= n <= len(y) - least:
                    mixed = (n * _gini(y[left]) + (len(y) - n) * _gini(y[~left])) / len(y)
                    if mixed < best[0] - 1e-12:
                        best = (mixed, (f, float(at)))
        if best[1] is None:
            return
        self._split(x, y, best[1], (), depth - 1, least)

    def _split(self, x: np.ndarray, y: np.ndarray, cut: tuple[int, float], first: tuple, depth: int, least: int) -> None:
        self.cut = cut
        self.value = bool(y.mean() >= 0.5) if len(y) else False
        left = x[:, cut[0]] <= cut[1]
        self.low, self.high = Tree(x[left], y[left], first, depth, least), Tree(x[~left], y[~left], first, depth, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.cut is None:
            return np.full(len(x), self.value)
        left = x[:, self.cut[0]] <= self.cut[1]
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def _gini(y: np.ndarray) -> float:
    p = y.mean()
    return float(2 * p * (1 - p))


_LONG = "The river rose during the night and by the morning water stood in the lower fields, which had not happened for thirty years."
_MORE = "People carried what they could to the school on the hill, and those who had boats went back for the animals."
_LINKS = "<ul>" + "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate(["Home", "World news", "Sport", "About us", "Contact"])) + "</ul>"
#: The labelled pages: html, with the blocks of main text marked by a leading *, which is taken off.
LABELLED = [
    f"<nav>{_LINKS}</nav><div class='ad'>Buy two lamps and get the third one free today.</div><article><h1>*High water</h1><p>*{_LONG}<p>*Then it fell.</p><p>*{_MORE}</p><p>*So it goes.</p></article><footer>&copy; The Paper. All rights reserved. <a href='/x'>Imprint</a></footer>",
    f"<header><div>The Daily Paper</div><p>News from the valley since 1901</p></header><main><h1>*A bridge</h1><p>*{_MORE}</p><p>*Yes.</p><ul><li>*one boat</li><li>*two ropes</li></ul><p>*{_LONG}</p></main><aside><h3>Most read</h3>{_LINKS}<p>Sign up for our letter, it comes each week and costs nothing at all.</p></aside>",
    f"<div id='top-menu'>{_LINKS}</div><div class='cookie-notice'><p>We use cookies to make this site better for you and to see how it is used.</p></div><div class='post-content'><h2>*Boats</h2><p>*{_LONG}</p><blockquote>*We saw it come.</blockquote><p>*{_MORE}</p></div><div id='comments'><article class='comment'><p>I was there and it was worse than you write here, believe me.</p></article><p>Thanks!</p></div><div id='footer'><p>Imprint and terms</p></div>",
    f"<div>{_LINKS}</div><h1>*Old mill</h1><p>*{_LONG}</p><p>*{_MORE}</p><p>*{_LONG} {_MORE}</p><div><a href='/a'>Back to the list</a> <a href='/b'>Next</a></div><p>Imprint</p>",
    f"<table><tr><td>{_LINKS}</td><td><h2>*Fields</h2><p>*{_LONG}</p><p>*{_MORE} <a href='/m'>map</a></p></td></tr></table><div>Copyright 1999</div>",
    f"<div>Welcome</div><div><a href='/1'>Home</a> | <a href='/2'>Archive</a></div><div>*{_MORE} {_LONG}</div><div>*{_LONG}</div><div><a href='/3'>Print this page</a></div>",
    f"<section class='story'><header><h1>*Rain</h1></header><p>*{_LONG}</p><div class='related'><h4>Related</h4><a href='/r'>A year of rain in the valley and the hills beyond</a></div><p>*{_MORE}</p><p>*The end.</p></section><div role='contentinfo'><p>Written by nobody in particular for no one at all.</p></div>",
    f"<article><p>*One.</p><p>*Two words.</p><p>*{_LONG}</p><table><tr><td>*Boats</td><td>*12</td></tr></table><div class='share'><a href='/t'>Tell a friend</a></div><div class='newsletter-signup'><p>Get the letter each week and never miss a story from the valley again.</p></div></article><div class='sidebar'><p>{_MORE}</p></div>",
    f"<main><div class='breadcrumbs'><a href='/'>Home</a> &gt; <a href='/v'>Valley</a></div><p>*See <a href='/q'>the full list of all the boats that were used</a></p><p>*<a href='/w'>The report</a></p><p>*{_MORE}</p></main><div>Advert: {_LONG}</div><div><p>Follow us</p><p>Imprint</p></div>",
    f"<div><p>Skip to text</p></div><div>{_LINKS}</div><div><p>*{_LONG}</p><p>*{_MORE}</p></div><div><p><a href='/s1'>More stories from the valley</a></p><p><a href='/s2'>Still more</a></p></div><div><p>All rights reserved</p></div>",
    f"<div class='cookie-consent'><p>{_LONG} {_MORE}</p></div><div class='sidebar'><p>{_MORE}</p><p>{_LONG}</p></div><h1>*Ice</h1><p>*{_LONG}</p><p>*{_MORE}</p><p>*Short it was.</p><p>*{_LONG}</p><div id='comments'><p>{_MORE}</p><p>{_LONG}</p></div><footer><p>{_LONG}</p></footer>",
    f"<nav><p>{_LONG}</p></nav><div class='promo'>{_LONG}</div><div class='promo'>{_MORE}</div><p>*{_LONG}</p><p>*A few words.</p><p>*{_MORE}</p><p>*{_MORE}</p><aside><p>{_MORE}</p><p>{_LONG}</p></aside><div class='legal'><p>{_LONG} {_MORE}</p></div>",
    f"<h1>*Ferry</h1><p>*{_LONG}</p><p>*{_MORE}</p><p>*{_LONG}</p>" + "".join(f"<div class='{c}'><p>{_LONG}</p><p>Ok</p><p>{_MORE}</p><p>{_LONG} {_MORE}</p><p>Two words</p></div>" for c in ("comments", "widget", "promo", "notice")),
    f"<div class='ads'><p>{_MORE}</p><p>{_LONG}</p><p>Now</p></div><p>*{_LONG} {_MORE}</p><p>*{_LONG}</p><p>*Nobody drowned in it.</p><p>*{_MORE}</p><footer><p>{_LONG} {_MORE}</p><p>Two words</p><p>{_LONG}</p></footer>",
    f"<div>{_LINKS}</div><article><h1>*Ebb</h1><p>*{_LONG}</p><p>*It was low.</p><p>*<a href='/l'>The whole list</a></p><p>*{_MORE}</p></article>",
    f"<p>Welcome</p><div class='article-body'><p>*{_MORE}</p><p>*<a href='/p'>Part two</a></p><p>*Read on.</p></div>",
    f"<main><p>*Low water.</p></main>",
    f"<main><h2>*Rope</h2><p>*{_LONG} {_MORE}</p><p>*End</p></main><footer><a href='/i'>Imprint</a></footer>",
    f"<div id='main-content'><p>*{_LONG}</p><p>*{_MORE}</p></div>",
    f"<h2>*Sand</h2><p>*{_LONG}</p><p>*{_MORE} {_LONG}</p><p>*{_MORE}</p>",
    f"<nav>{_LINKS}</nav><p>Welcome</p><article><h1>*Eels</h1><p>*Yes.</p><p>*{_LONG}</p><p>*No.</p><p>*Why?</p><p>*It was in the water for three nights.</p><ul><li>*one</li><li>*two</li><li>*three</li></ul><p>*End.</p></article><div>Printed on Monday</div><div>{_MORE}</div>",
    f"<div>Edition two</div><main><h2>*Hay</h2><p>*{_MORE}</p><p>*Short.</p><p>*Very.</p><table><tr><td>*a</td><td>*b</td></tr><tr><td>*1</td><td>*2</td></tr></table><p>*<a href='/z'>The whole table</a></p><p>*So.</p></main><div>{_LINKS}</div><div>{_LONG}</div><p>By the same hand</p>",
    # pages whose containers say nothing: words and links of a block and its neighbours must do
    f"<div>{_LINKS}</div><div>Rain at times</div><div><a href='/a'>Today</a> <a href='/b'>Tomorrow</a></div><h1>*Tide</h1><div>*{_LONG}</div><div>*It turned.</div><div>*{_MORE}</div><h3>More to read</h3>{_LINKS}<div>All rights reserved</div>",
    f"<div>{_LINKS}</div><div>Photo: the valley</div><div>{_LINKS}</div><div>*{_MORE}</div><div>*Photo: the bridge</div><div>*{_LONG}</div><div>{_LINKS}</div><div>Our other papers</div><div>{_LINKS}</div>",
    "".join(f"<div>{t}</div><div><a href='/{i}'>Read more</a></div>" for i, t in enumerate(["Boats were seen again on the upper lake late last week.", "The old mill is to open its doors to all.", "A year of rain in the valley and in the hills."]))
    + f"<h1>*Snow</h1><div>*{_MORE}</div><div>*The road is shut and will stay so until spring.</div><div>*{_LONG} {_MORE}</div><div><a href='/9'>All stories</a></div>",
    f"<div>{_LINKS}</div><h1>*At the ferry</h1><div>*{_LONG}</div><div>*Who goes there?</div><div>*Two men and a dog.</div><div>*Come over then.</div><div>*We can not pay.</div><div>*{_MORE}</div><div>{_LINKS}</div>",
    f"<div>{_LINKS}</div><div>*{_LONG} <a href='/m'>The map</a> and <a href='/n'>the list of names</a> show where.</div><div>*{_MORE}</div><div>*See <a href='/o'>the older report</a> too.</div><div>*{_LONG}</div><div>See also <a href='/p'>boats for sale</a> and <a href='/q'>rope by the yard</a></div><div>{_LINKS}</div>",
    f"<h2>Latest</h2>{_LINKS}<h2>*Mud</h2><div>*{_MORE}</div><h3>*What was lost</h3><div>*{_LONG}</div><h3>*What was found</h3><div>*{_MORE}</div><h3>Elsewhere</h3>{_LINKS}<h3>Services</h3>{_LINKS}",
    f"<div>Edition of Monday</div><div>{_LINKS}</div><div>*{_LONG}</div><ul><li>*a rope of forty feet</li><li>*two lamps</li><li>*bread for a week</li></ul><div>*{_MORE}</div><ul><li><a href='/1'>Rope</a></li><li><a href='/2'>Lamps</a></li><li><a href='/3'>Bread</a></li></ul><div>Imprint</div>",
    f"<table><tr><td>{_LINKS}</td></tr><tr><td>*{_MORE} {_LONG}</td></tr><tr><td>*Nobody came.</td></tr><tr><td>*{_LONG}</td></tr><tr><td><a href='/t'>Top</a></td></tr><tr><td>Seen by many</td></tr></table>",
    f"<div>{_LINKS}</div><div>*{_MORE}</div><div>*{_LONG}</div><div><a href='/a'>Older</a> <a href='/b'>Newer</a></div><div>Part of the valley group of papers</div><div><a href='/c'>Imprint</a></div>",
    "".join(f"<div>{t}</div><div><a href='/{i}'>{a}</a></div>" for i, (t, a) in enumerate([(_MORE, "How the people of the upper valley saved their animals"), (_LONG, "Thirty years of high water in the lower fields, in pictures"), ("The mill is open to all who come by boat this week.", "Where to leave a boat near the old mill")]))
    + f"<h1>*Frost</h1><div>*{_MORE}</div><div>*The road to the school is shut until the spring.</div><div>*{_LONG}</div><div>*Nobody has come down from the hill since then.</div><div>*{_MORE}</div><div>*It is cold.</div><div>*{_LONG}</div>",
    "".join(f"<div><a href='/{i}'>{a}</a></div><div>{t}</div>" for i, (t, a) in enumerate([(_LONG, "Thirty years of high water in the lower fields"), (_MORE, "Boats went back for the animals on the second day of the flood")]))
    + f"<div>{_LINKS}</div><div>*{_LONG} {_MORE}</div><div>*Few of the old boats are left in the valley.</div><div>*{_MORE}</div><div>*{_LONG}</div><div><a href='/x'>All that was written in this paper about the boats</a></div><div>Written by the people of the valley for all others.</div><div>{_LINKS}</div>",
    # class names that can mean many things, on the article itself and beside it
    f"<div>{_LINKS}</div><div class='discussion-paper'><h1>*Dams</h1><p>*{_LONG}</p><p>*{_MORE}</p><p>*So much for that.</p><p>*{_LONG}</p></div><div>Imprint</div>",
    f"<div class='widget'><p>{_MORE}</p></div><div class='legal-review'><h2>*Rights of way</h2><p>*{_MORE}</p><p>*{_LONG} {_MORE}</p><p>*{_LONG}</p></div><div class='notice'><p>{_LONG}</p></div>",
    f"<div class='search-results'><h1>*Lost and found</h1><p>*{_LONG}</p><p>*{_MORE} {_LONG}</p></div><div class='promo'><p>{_MORE}</p></div>",
    f"<article><h1>*Sluice</h1><p>*{_LONG}</p><div class='alert'><p>{_MORE}</p></div><p>*{_MORE}</p><p>*{_LONG}</p><div class='related'><p>{_LONG}</p></div></article><div class='responses'><p>{_MORE}</p><p>{_LONG}</p></div>",
    f"<form action='/page'><header><p>The Daily Paper</p></header><main><h1>*Locks</h1><p>*{_LONG}</p><p>*{_MORE}</p></main><footer><p>Imprint</p></footer></form>",
]


def labelled_table(pages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The training table: features and whether a block is main text."""
    x, y = [], []
    for page in pages or LABELLED:
        made, asked = features(blocks(page.replace("*", "")))
        x.append(made[asked])
        y += [b.text.startswith("*") for b, ok in zip(blocks(page), asked, strict=True) if ok]
    return np.concatenate(x), np.array(y, bool)


def train(pages: list[str] | None = None) -> Tree:
    """Blocks in, beside and without marked main text are told apart first, all else is found."""
    held = FEATURES.index("held")
    return Tree(*labelled_table(pages), first=((held, -0.5), (held, 0.5)))


def main_text(page: str | None, tree: Tree) -> str:
    if not page:
        return ""
    for forms, sure in ((False, True), (True, True), (True, False)):
        found = blocks(page, forms, sure)
        x, asked = features(found)
        chosen = asked & tree.predict(x)
        if chosen.any():
            return "\n".join(b.text for b, ok in zip(found, chosen, strict=True) if ok)
    return ""


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    tune(pages.sparkSession, 500)
    tree = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
