"""Main text of HTML pages by composite text density.

Every DOM node has a density: characters per tag, weighed by how few of its characters and tags belong to links; nodes of links alone have none, and it does not grow with
a node's size. The sum of its children's densities is largest for the node that holds an article's paragraphs; it is sought among the elements that hold others, as a
paragraph alone is no article. That node is the article, or the article or main element around it, whose authors say what belongs to it: then nothing is added. Else
a share of the least density on its path up to the body, which itself is diluted by all else, and no less than a smaller share of its own, is the threshold: what stands beside that path and is at least so dense belongs to the article too, and so
does a heading that stands before such a part.

Elements that by their tag, role or attributes are no article text (menus, adverts, forms and so on) are left out of the tree from the start, and so
are those whose class or id names such a part. Words that are said of other things too count as the last one of a name only, generic words such as box aside: share-price is a price, share-box is not. A class or id
alone does not leave out what holds an article or main element, and one that says more than such a name (widget-container)
does not leave out most of the page's plain text, be it in one element or in all that have the word; there the densities decide.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common

#: Kinds of elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside form menu select button textarea title iframe object canvas svg dialog noembed noframes xmp".split())
#: Start tags that end an open paragraph, and which open elements a start tag ends, up to the given bounds.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_LIKE = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Elements that begin a block of text; all others, unknown ones too, run on in theirs.
BLOCK = ENDS_PARAGRAPH | DROPPED | frozenset(ENDS_LIKE) | frozenset("html body thead tfoot caption colgroup legend summary optgroup title".split())
ARTICLE = frozenset(("article", "main"))
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words in class or id that mark what is no article text.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo promoted promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)

#: Words in a class or id that say nothing about what an element holds, and first words of those that describe the page instead.
GENERIC_NAMES = frozenset("area bar block body bottom box btn bottoms button buttons col column container content element entries feed group holder icons inner item items left line link links list main outer panel post posts right row section sections slot space top unit view wrap wrapper zone".split())
STATE_NAMES = frozenset("has is no non not with without".split())
#: Names of an article's own heading, which is part of it.
HEADING_NAMES = frozenset(("header", "masthead"))
ARTICLE_NAMES = frozenset("article entry post story recipe chapter title content".split())
#: Names that are also said of what an article tells; they count only where they are a name's last telling word.
WEAK_NAMES = frozenset("banner consent cookie cookies header masthead menu notice notices promoted related respond share sharing social".split())
#: Elements that do not hold a whole article: single blocks of text.
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address caption figcaption legend summary option tr td th hr".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The least shares of links that count, so that no link at all is worth no more than a few; and the shares of the least density on the path, and of the article's own, that text beside it must have.
LEAST_LINKS = 0.01
PATH_SHARE, OWN_SHARE = 0.3, 0.15

_TAG_PATTERN = r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]LIMIT"|'[^']LIMIT')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"""
_TAG = re.compile(_TAG_PATTERN.replace("LIMIT", "*+"), re.S)
#: After a quote that no other one ends, values are read up to this length only, as each search for their ends goes through the page.
_TAG_SHORT = re.compile(_TAG_PATTERN.replace("LIMIT", "{0,2000}+"), re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CACHED_CHARS = 256


class _Drop(NamedTuple):
    always: bool
    words: frozenset[str] = frozenset()  # of class and id, that mark it as no article text
    exact: bool = False  # a class or the id consists of such words alone


def _named(token: str, in_article: bool) -> frozenset[str]:
    """The words of a class or id that mark what has it as no article text."""
    words = [w.lower() for w in _NAME_WORDS.findall(token)]
    if not words or words[0] in STATE_NAMES or any(w in STATE_NAMES for w in words[1:-1]):
        return frozenset()
    found = DROPPED_NAMES.intersection(words)
    if found - WEAK_NAMES:
        return found
    last = next((w for w in reversed(words) if w not in GENERIC_NAMES), words[-1])
    if last not in found or last in HEADING_NAMES and (in_article or not ARTICLE_NAMES.isdisjoint(words)):
        return frozenset()
    return found


def _dropped(tag: str, attributes: str, in_article: bool) -> _Drop:
    return (_kept_drops if len(attributes) <= _CACHED_CHARS else _drop)(tag, attributes, in_article)


def _drop(tag: str, attributes: str, in_article: bool) -> _Drop:
    if tag in DROPPED or tag == "header" and not in_article:
        return _Drop(True)
    marks, exact, seen = set(), False, set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in seen:
            continue
        seen.add(name)
        if name == "role" and value.lower() in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return _Drop(True)
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _Drop(True)
        if name not in ("class", "id"):
            continue
        if tag not in ("html", "body", *ARTICLE):
            for token in value.split():
                words = _named(token, in_article)
                only = bool(words) and len(words) == len({w.lower() for w in _NAME_WORDS.findall(token)})
                marks |= words
                exact |= only
        if tag == "article" and any(w.lower() in ("comment", "comments", "ad", "advert", "promo", "related") for w in _NAME_WORDS.findall(value)):
            return _Drop(True)
    return _Drop(False, frozenset(marks), exact)


_kept_drops = lru_cache(4096)(_drop)


class _Node:
    __slots__ = ("tag", "parent", "end", "chars", "tags", "link_chars", "link_tags", "density", "children_density", "link", "dropped", "why", "never", "plain", "holds")

    def __init__(self, tag: str, parent: int, link: bool, dropped: bool, why: _Drop = _Drop(False), never: bool = False) -> None:
        self.tag, self.parent, self.link, self.dropped, self.why, self.never = tag, parent, link, dropped, why, never
        self.end = self.chars = self.tags = self.link_chars = self.link_tags = 0
        # characters outside links, and if there is an article or main element, both without what is dropped whatever its names are spared
        self.plain, self.holds = 0, False
        self.density = self.children_density = 0.0


def parse(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[_Node], list[tuple[int, str]]]:
    """Nodes in page order (0 is the root; ``end`` closes a node's subtree) and the text blocks with the node each began in.

    spared: nodes that their class or id does not drop. The nodes' numbers do not depend on it.
    """
    nodes = [_Node("#root", -1, False, False)]
    stack = [0]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag in the stack
    open_blocks: list[int] = []  # places of the open block elements
    blocks: list[tuple[int, str]] = []
    held: list[str] = []
    owner = 0
    at, size, article_depth, pattern = 0, len(page), 0, _TAG

    def put() -> None:
        nonlocal held
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append((owner, text))
            held = []

    def say(text: str) -> None:
        nonlocal owner
        node = nodes[stack[-1]]
        if node.never:
            return
        if "&" in text:
            text = entities.unescape(text)
        n = len(text.strip())
        if not node.link:
            node.plain += n
        if node.dropped:
            return
        if not held:
            owner = stack[-1]
        held.append(text)
        node.chars += n
        if node.link:
            node.link_chars += n

    def close() -> None:
        nonlocal article_depth
        i = stack.pop()
        node = nodes[i]
        node.end = len(nodes)
        if i:
            places[node.tag].pop()
        if node.tag in BLOCK:
            open_blocks.pop()
            put()
        if node.tag in ARTICLE:
            article_depth -= 1
        if node.parent >= 0 and not node.never and (node.holds or not node.why.exact):
            nodes[node.parent].plain += node.plain
            nodes[node.parent].holds |= node.holds or node.tag in ARTICLE
        if node.parent >= 0 and not node.dropped:
            up = nodes[node.parent]
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_to(names, bounds) -> None:
        k = last(names)
        if k and k > last(bounds):
            while len(stack) > k:
                close()

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        m = pattern.match(page, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if m[5]:
            pattern = _TAG_SHORT
        if not tag:
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag not in BLOCK:
                k = places[tag][-1] if places.get(tag) else 0
                if k and (not open_blocks or k > open_blocks[-1]):
                    while len(stack) > k:
                        close()
            elif tag == "p":
                close_to({"p"}, ENDS_PARAGRAPH - {"p"})
            elif tag not in ("html", "body"):
                close_to({tag}, ())
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag in BLOCK:
            if tag in ENDS_PARAGRAPH:
                close_to({"p"}, ENDS_PARAGRAPH - {"p"})
            if tag in ENDS_LIKE:
                close_to(*ENDS_LIKE[tag])
            elif nodes[stack[-1]].tag == "head" and tag not in DROPPED | VOID:
                close()
        up = nodes[stack[-1]]
        if tag in VOID:
            up.tags += not up.dropped
            if tag == "br" and held:
                held.append(" ")
            elif tag == "hr":
                put()
            continue
        if tag in BLOCK:
            put()
        why = _dropped(tag, attributes, article_depth > 0)
        dropped = up.dropped or why.always or bool(why.words) and len(nodes) not in spared
        nodes.append(_Node(tag, stack[-1], up.link or tag == "a", dropped, why, up.never or why.always))
        places[tag].append(len(stack))
        if tag in BLOCK:
            open_blocks.append(len(stack))
        stack.append(len(nodes) - 1)
        article_depth += tag in ARTICLE
        if attributes.endswith("/") and tag in ("svg", "path"):
            close()
        elif tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not closing:
                break
            at = closing.start()
    while stack:
        close()
    put()
    return nodes, blocks


def _spared(nodes: list[_Node]) -> frozenset[int]:
    """The nodes that their class or id must not drop, as they hold an article or main element or most of the page's plain text."""
    named = [i for i, n in enumerate(nodes) if n.why.words and not n.never]
    most = nodes[0].plain / 2
    spared = {i for i in named if nodes[i].holds or not nodes[i].why.exact and nodes[i].plain > most}
    rest = [i for i in named if i not in spared and not nodes[i].why.exact]
    # wrappers of parts: a word whose elements have most of the text together tells nothing on this page
    totals: Counter[str] = Counter()
    until: dict[str, int] = {}
    for i in rest:
        for word in nodes[i].why.words:
            if until.get(word, 0) <= i:
                totals[word] += nodes[i].plain
                until[word] = nodes[i].end
    return frozenset(spared.union(i for i in rest if all(totals[word] > most for word in nodes[i].why.words)))


def _density(node: _Node, body: _Node) -> float:
    """Characters outside links per tag, times the logarithm of how rare links are among both, to a base that grows with the links of the node and of the page."""
    if not node.chars:
        return 0.0
    tags = max(1, node.tags)
    of_chars, of_tags = node.link_chars / node.chars, node.link_tags / tags
    rare = max(0.0, -math.log(min(1.0, of_chars + LEAST_LINKS) * min(1.0, of_tags + LEAST_LINKS)))
    base = math.log(of_chars / max(LEAST_LINKS, 1 - of_chars) + body.link_chars / max(1, body.chars) + math.e)
    return (node.chars - node.link_chars) / tags * rare / base


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, white space inside each made one blank, joined by a blank line; empty if there is none."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    if spared := _spared(nodes):
        nodes, blocks = parse(page, spared)
    if not blocks:
        return ""
    body = next((i for i, n in enumerate(nodes) if n.tag == "body"), 0)
    for node in nodes:
        if not node.dropped:
            node.density = _density(node, nodes[body])
            if node.parent >= 0:
                nodes[node.parent].children_density += node.density
    inside = range(body, nodes[body].end)
    best = max((i for i in inside if not nodes[i].dropped and nodes[i].tag in BLOCK and nodes[i].tag not in TEXT_BLOCK or not i), key=lambda i: nodes[i].children_density, default=body)
    path = [best]
    while path[-1] != body and nodes[path[-1]].parent >= 0:
        path.append(nodes[path[-1]].parent)
    best = next((i for i in path if nodes[i].tag in ARTICLE), best)
    path = path[path.index(best) :]
    taken = bytearray(len(nodes))
    taken[best : nodes[best].end] = b"\1" * (nodes[best].end - best)
    if nodes[best].tag not in ARTICLE:
        threshold = max(PATH_SHARE * min(nodes[i].density for i in path if i != body or best == body), OWN_SHARE * nodes[best].density)
        on_path, parents = set(path), set(path) - {best}
        beside: dict[int, list[int]] = {}  # the path's nodes' children in page order
        for i, n in enumerate(nodes):
            if n.parent in parents and not n.dropped:
                beside.setdefault(n.parent, []).append(i)
        for children in beside.values():
            follows = False
            for i in reversed(children):
                n = nodes[i]
                if i not in on_path:
                    if n.density >= threshold > 0 or follows and n.tag in HEADINGS and n.chars > n.link_chars:
                        taken[i : n.end] = b"\1" * (n.end - i)
                        follows = True
                    elif n.chars:
                        follows = False
                else:
                    follows = True
    return "\n\n".join(text for owner, text in blocks if taken[owner])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    pages: page_id, url and html, other columns are ignored. A null or empty html, or one without article text, gives the empty text;
    repeated rows are answered each; an empty table gives no rows. Runs in the tasks that read the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "html"):
                found = [main_text(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
