"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Elements that are no content by their tag,
role, class or id (menus, headers, footers, sidebars, notices, adverts, forms,
comments and the like) are taken out.  A class or id counts by its whole name: a
listed word, or listed words joined with words of place and shape (site-header,
sidebar-left).  By such a name nothing is taken out that holds an article or main
when no other stands elsewhere, nor what holds most of the page's unlinked text (if the
name is one of adverts, nearly all of it and several paragraphs; names of comments and consent
have no such exception), nor any heading; inside an article or main an id, which is often a heading's anchor, names
only comments and adverts.  A form is held to the same rule, its controls always go.  Every node gets its composite text
density: characters per tag, weighted down by the share of its characters and
tags that belong to links, measured against the same share in the whole body.
A node's density sum adds up its children's densities, a run of text of its own
counting as a child of one tag.  The node with the largest sum gives the
threshold, the smallest density on its path to the body.  The walk goes down from
the body into every node whose density reaches the threshold and marks its
subtree's node of the largest sum.  The text is all that is marked and, where
several of the body's children are marked or the body itself has the largest sum,
the others of its children but lists of links (several, with most of the child's
characters) and boxes under half the threshold (or half of the densest child, if less); a box has
a class or id and is no heading, paragraph, list, table, quotation or figure (a body with text of
its own is whole).  A marked node stands for the whole article or main around it.

Text is cut into blocks at block elements, white space inside a block becomes
one space, and blocks are joined by a line feed.

Defined results: null, empty and text-free pages give ''; repeated rows are
handled one by one; columns other than id, URL and html are dropped; an empty
table gives an empty table.  Trees are walked without recursion, so deep
nesting is no limit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import tidy


def fixed():
    """Element names by their part in a page, and words of a class or id that mark no content.

    ``others``: those of the words that name other people's text, ``adverts`` among them; ``anchored``: those that count as an id inside an article;
    ``joined``: what may stand beside a word in a class or id."""
    return {
        "void": frozenset("area base br col embed hr img input link meta param source track wbr".split()),
        "block": frozenset(
            "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
        ),
        "space": frozenset(["br", "wbr", "img", "input"]),
        "dropped": frozenset(
            "nav header footer aside script style noscript template head title button select option textarea input iframe object embed svg canvas "
            "audio video map dialog menu".split()
        ),
        "roles": frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split()),
        "words": frozenset(
            "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr header "
            "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies respond share sharing "
            "sidebar skyscraper social sponsor sponsored subscribe toolbar".split()
        ),
        "others": frozenset(
            "ad ads adv advert adverts advertisement advertising adsense comment commentlist comments consent cookie cookies disqus gdpr promo promoted promotion replies respond skyscraper "
            "sponsor sponsored".split()
        ),
        "joined": frozenset(
            "area bar block bottom box button buttons col column container desktop fixed global group holder icon icons inner item items left link links list main mobile outer "
            "panel posts primary reader readers right secondary section site slot sticky thread top unit user users widget widgets wrap wrapper zone".split()
        ),
        "adverts": frozenset("ad ads adv advert adverts advertisement advertising adsense promo promoted promotion skyscraper sponsor sponsored".split()),
        "anchored": frozenset("ad ads adv advert adverts advertisement advertising adsense comment commentlist comments disqus replies respond sponsored".split()),
        "headings": frozenset("h1 h2 h3 h4 h5 h6".split()),
        "plain": frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl table pre blockquote figure".split()),
        "kept": frozenset("html body article main".split()),
        "closes_p": frozenset(
            "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
            "menu nav ol p pre section summary table ul li dd dt".split()
        ),
        "closes_same": {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)},
    }


class Tree(HTMLParser):
    """Elements in page order with their parents, and each element's runs of text."""

    def __init__(self, values: dict):
        super().__init__(convert_charrefs=True)
        self.v = values
        self.clear()

    def clear(self) -> None:
        self.reset()
        self.tag, self.parent, self.drop = [""], [-1], [False]
        #: by class or id no content: 1, or if other people's text 2 for adverts and 3 for the rest
        self.named: dict[int, int] = {}
        #: those with a class or id that are no plain block
        self.boxes: set[int] = set()
        self.in_article = [False]
        self.open, self.is_open = [0], Counter()
        #: (element, text) in page order; a text of None is a break between blocks
        self.runs: list[tuple[int, str | None]] = []

    def handle_starttag(self, tag, attrs):
        v = self.v
        if tag in v["closes_p"]:
            self._close("p", ("table", "td", "th", "button"))
        if tag in v["closes_same"]:
            for other in {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)):
                self._close(other, v["closes_same"][tag])
        above = self.open[-1]
        if tag in v["block"]:
            self.runs.append((above, None))
        if tag in v["space"]:
            self.runs.append((above, " "))
        self.tag.append(tag)
        self.parent.append(above)
        self.drop.append(self.drop[above] or self._no_content(tag, attrs))
        self.in_article.append(self.in_article[above] or tag in ("article", "main"))
        if not self.drop[-1] and tag not in v["kept"] and tag not in v["headings"] and (kind := max(self._named(attrs, self.in_article[-1]), tag == "form")):
            self.named[len(self.tag) - 1] = kind
        if tag not in v["plain"] and any(name in ("class", "id") for name, _ in attrs):
            self.boxes.add(len(self.tag) - 1)
        if tag not in v["void"]:
            self.open.append(len(self.tag) - 1)
            self.is_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _no_content(self, tag: str, attrs) -> bool:
        v = self.v
        if tag in v["kept"]:
            return False
        if tag in v["dropped"]:
            return True
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "role" and value in v["roles"] or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and "display:none" in value.replace(" ", ""):
                return True
        return False

    def _named(self, attrs, in_article: bool) -> int:
        v, kind = self.v, 0
        for name, value in attrs:
            if name in ("class", "id"):
                for whole in (value or "").lower().split():
                    parts = set(re.findall(r"[^\W\d_]+", whole))
                    words = parts & v["words"]
                    if name == "id" and in_article:
                        words &= v["anchored"]
                    if words and parts - words <= v["joined"]:
                        kind = max(kind, 1 if words.isdisjoint(v["others"]) else 3 if words & v["others"] - v["adverts"] else 2)
        return kind

    def handle_endtag(self, tag):
        self._close(tag, ())

    def _close(self, tag: str, stop: tuple) -> None:
        if not self.is_open[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[k]]
            if name == tag:
                if tag in self.v["block"]:
                    self.runs.append((self.open[k], None))
                self.is_open.subtract(self.tag[i] for i in self.open[k:])
                del self.open[k:]
                return
            if name in stop:
                return

    def handle_data(self, data):
        self.runs.append((self.open[-1], data))


class Densities(NamedTuple):
    own: dict[int, int]  # characters of an element's own
    chars: list[int]  # of its whole subtree, as the next two
    link_chars: list[int]
    link_tags: list[int]
    density: list[float]


def densities(tree: Tree) -> Densities:
    """The composite text density of every element that is not dropped, and what it is made of."""
    tag, parent, drop = tree.tag, tree.parent, tree.drop
    n = len(tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tag[i] == "a" or in_link[parent[i]]
    own: dict[int, int] = {}
    whole = linked = 0
    for i, text in tree.runs:
        if text and (size := len("".join(text.split()))):
            if tag[i] not in ("script", "style", "title"):
                whole, linked = whole + size, linked + size * in_link[i]
            if not drop[i]:
                own[i] = own.get(i, 0) + size
                chars[i] += size
                link_chars[i] += size * in_link[i]
    for i in range(n - 1, 0, -1):
        if not drop[i]:
            p = parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i] + (tag[i] == "a")
    share = linked / whole if whole else 0.0
    density = [0.0] * n
    for i in range(n):
        if chars[i]:
            c, t, lc, lt = chars[i], max(tags[i], 1), link_chars[i], link_tags[i]
            # one more inside both logarithms than in the published form, which divides by 0 where there are no links
            base = math.log(1 + math.log(c * lc / max(c - lc, 1) + share * c + math.e))
            density[i] = c / t * math.log(1 + c * t / (max(lc, 1) * max(lt, 1))) / base
    return Densities(own, chars, link_chars, link_tags, density)


def main_text(html: str | None, tree: Tree) -> str:
    """The text of the page's main content, blocks joined by a line feed."""
    if not html:
        return ""
    tree.clear()
    tree.feed(html)
    tree.close()
    _drop_named(tree)
    tag, parent, drop, n = tree.tag, tree.parent, tree.drop, len(tree.tag)
    own, chars, link_chars, link_tags, density = densities(tree)
    total = [float(own.get(i, 0)) for i in range(n)]
    best = list(range(n))
    for i in range(n - 1, 0, -1):  # a node's own sum is complete before its parent's
        total[parent[i]] += density[i]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if total[best[i]] > total[best[p]] or total[best[i]] == total[best[p]] and best[p] == p:
            best[p] = best[i]
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    if not chars[body]:
        body = 0
    top = best[body]
    threshold, i = density[top], top
    while i > body:
        i = parent[i]
        threshold = min(threshold, density[i])
    marked, reached, inside = [], [False] * n, [False] * n
    reached[body] = True
    for i in range(body + 1, n):
        if drop[i] or not chars[i] or not reached[parent[i]]:
            continue
        if density[i] >= threshold:
            reached[i] = inside[best[i]] = True
            if parent[i] == body:
                marked.append(i)
    if not marked and top != body:
        inside[top] = True
    elif top == body or len(marked) > 1:
        inside[body] = body in own  # then its own text and all else
        children = [i for i in range(body + 1, n) if parent[i] == body and chars[i] and not drop[i]]
        boxed = min(threshold, max((density[i] for i in children), default=0.0)) / 2
        for i in children:
            if (i not in tree.boxes or density[i] >= boxed) and (link_tags[i] < 2 or 2 * link_chars[i] <= chars[i]):
                inside[i] = True
    around = [-1] * n  # the outermost article or main below the body
    for i in range(body + 1, n):
        around[i] = around[parent[i]]
        if around[i] < 0 and tag[i] in ("article", "main"):
            around[i] = i
        if inside[i] and around[i] >= 0:
            inside[around[i]] = True
    for i in range(1, n):
        inside[i] = inside[i] or inside[parent[i]]
    blocks, held = [], []
    for i, text in tree.runs:
        if text is None:
            blocks.append("".join(held))
            held = []
        elif inside[i] and not drop[i]:
            held.append(text)
    blocks.append("".join(held))
    return "\n".join(b for x in blocks if (b := " ".join(x.split())))


def _drop_named(tree: Tree) -> None:
    """Drop what its class or id names as no content, but not the article or most of the unlinked text."""
    if not tree.named:
        return
    tag, parent, drop, named = tree.tag, tree.parent, tree.drop, tree.named
    n = len(tag)
    linked, within = [False] * n, [False] * n
    for i in range(1, n):
        linked[i] = tag[i] == "a" or linked[parent[i]]
        within[i] = i in named or within[parent[i]]
    held, paragraphs = [0] * n, [int(t == "p") for t in tag]
    for i, text in tree.runs:
        if text and not drop[i] and not linked[i]:
            held[i] += len("".join(text.split()))
    article = [tag[i] in ("article", "main") and not drop[i] for i in range(n)]
    elsewhere = any(article[i] and not within[i] for i in range(n))
    for i in range(n - 1, 0, -1):
        held[parent[i]] += held[i]
        paragraphs[parent[i]] += paragraphs[i]
        article[parent[i]] = article[parent[i]] or article[i]
    for i in range(1, n):
        if i in named and not (article[i] and not elsewhere):
            most = {1: 2 * held[i] > held[0], 2: held[i] > 0.95 * held[0] and paragraphs[i] > 1}.get(named[i], False)
            drop[i] = drop[i] or not most
        drop[i] = drop[i] or drop[parent[i]]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_chars: int = 4_000_000) -> DataFrame:
    """(id, url, text) of every page; a task holds the texts of about ``block_chars`` characters of pages."""

    def run(batches):
        tree = Tree(fixed())
        for batch in batches:
            at, out, size = 0, [], 0
            for row in range(batch.num_rows):
                html = batch.column(2)[row].as_py()
                out.append(main_text(html, tree))
                size += len(html or "")
                if size >= block_chars or row == batch.num_rows - 1:
                    part = batch.slice(at, len(out))
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(out, pa.string())], [id_col, url_col, "text"])
                    at, out, size = row + 1, [], 0

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(tidy(run), f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string")
