"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to the elements around them, half as many to the next ones; an element's points
are discounted by the share of its text that stands in links. The best container is kept with all of the article or main element around it but
lists of links, and with those siblings of it that score well, without the parts that are no article (menus, forms, notices, comments and the like).
Class names only hint at such parts: whole names count, a name that stands for content outweighs them, and they never take away what holds the
page's longest article or main element, nor all paragraphs of a page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A quote counts after an equals sign only. No part is matched in two ways, and a tag that never ends takes the rest, so that time is linear.
TAG = re.compile(
    r"<(?:!--(.*?)(?:-->|\Z)|([!?])[^>]*>|(/?)([a-zA-Z][^\s/>]*)"
    r"((?>[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title".split())  # their content is no text
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav aside footer form button select dialog menu head object embed fieldset label input option".split())
CLOSES_P = BLOCKS - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th"}
# An element of the first set ends an open one of the second, up to the containers of the third.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words of class names and ids of parts that are no article, of parts that are, and words that leave the meaning to the others.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners promo promos promotion sponsor sponsors "
    "sponsored breadcrumb breadcrumbs comment comments replies respond disqus cookie cookies consent gdpr footer header masthead menu menus "
    "nav navbar navigation sidebar related recommend recommended recommendations share sharing social subscribe subscription newsletter "
    "signup popup modal overlay notice notices alert toolbar widget widgets pager pagination skip login search copyright legal".split()
)
LIKELY = frozenset("article body content entry main post story text".split())
NEUTRAL = frozenset(
    "area bar block body box button buttons center col column container content first form group holder icons inner item items left links list "
    "outer panel posts right row section text top bottom wrap wrapper".split()
)
ABSENT = frozenset("has is no not with without hide show".split())
WORD = re.compile(r"[a-z0-9]+")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
START = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 3.0, "blockquote": 2.0, "pre": 2.0, "td": 2.0,
         "ul": -3.0, "ol": -3.0, "dl": -3.0, "form": -10.0, "body": -5.0, "html": -10.0}


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "unlikely", "likely", "points", "length", "linked")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, unlikely: bool = False, likely: bool = False):
        self.tag, self.parent, self.dropped, self.unlikely, self.likely = tag, parent, dropped, unlikely, likely
        self.children: list[Node | str] = []
        self.points, self.length, self.linked = 0.0, 0, 0


def _is_unlikely(name: str) -> bool:
    """Whether a class name or id stands for a part that is no article: by its last word, or by all words that say anything;
    names like has-sidebar only speak of such a part."""
    words = WORD.findall(name)
    if not words or words[0] in ABSENT:
        return False
    telling = [word for word in words if word not in NEUTRAL and not word.isdigit()]
    return words[-1] in UNLIKELY or bool(telling) and all(word in UNLIKELY for word in telling)


def _kind(tag: str, attributes: str, parent: Node) -> tuple[bool, bool, bool]:
    """(dropped, unlikely, likely) of an element."""
    page_part = tag in DROPPED or tag == "header" and parent.tag not in ("article", "section", "main")
    if not attributes.strip():
        return page_part, False, False
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    likely = any(words and LIKELY.issuperset(words) for words in map(WORD.findall, names))
    unlikely = not likely and tag not in ("p", "a", "b", "i", "span", "em", "strong") and any(map(_is_unlikely, names))
    return page_part or hidden or found.get("role", "").lower() in ROLES, unlikely, likely


def parse(html: str) -> Node:
    """A forgiving tree: unclosed elements end with their parents, stray end tags are ignored."""
    root = at = Node("html", None)
    position, last = 0, max(html.rfind(">"), html.rfind("<!--"))
    opened: Counter[str] = Counter()  # open elements by tag, so that stray end tags need no search

    def up_to(node: Node) -> Node:
        """Closes all open elements up to the node and the node itself."""
        here = at
        while here is not node.parent:
            opened[here.tag] -= 1
            here = here.parent
        return here

    while True:
        match = TAG.search(html, position) if position <= last else None
        text = html[position : match.start() if match else len(html)]
        if text:
            at.children.append(text)
        if not match:
            return root
        position = match.end()
        tag = match[4]
        if tag is None:
            continue
        tag = tag.lower()
        if match[3]:
            if not opened[tag]:
                continue
            node = at
            while node.tag != tag:
                if node.tag in BLOCKS and tag not in BLOCKS:  # an inline end tag does not close a block
                    break
                node = node.parent
            if node.tag == tag:
                at = up_to(node)
            continue
        if tag in RAW:
            if not match[5].rstrip().endswith("/") or tag in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, position)
                position = end.end() if end else len(html)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and opened["p"]:
            node = at
            while node.tag != "p":
                node = node.parent
            at = up_to(node)
        if tag in ENDED_BY and any(opened[other] for other in ENDED_BY[tag][0]):
            ended, within = ENDED_BY[tag]
            node = at
            while node is not root and node.tag not in ended and node.tag not in within:
                node = node.parent
            if node.tag in ended:
                at = up_to(node)
        child = Node(tag, at, *_kind(tag, match[5], at))
        at.children.append(child)
        if tag not in VOID and not match[5].endswith("/"):
            at = child
            opened[tag] += 1


def _order(root: Node) -> list[Node]:
    """Elements that are not dropped, parents first."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        found.append(node)
        waiting += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    return found


def _score(root: Node) -> list[Node]:
    nodes = _order(root)
    commas = {}
    for node in reversed(nodes):
        length = linked = count = 0
        for child in node.children:
            if isinstance(child, str):
                size = len(" ".join(child.split()))
                length += size
                count += child.count(",") + child.count("،") + child.count("、")
            elif not child.dropped:
                length += child.length
                linked += child.length if child.tag == "a" else child.linked
                count += commas[child]
        node.length, node.linked, commas[node] = length, linked, count
    for node in nodes:
        node.points += START.get(node.tag, 0.0) + (10.0 if node.likely else 0.0)
    for node in nodes:
        if node.tag in SCORED and node.length and node.parent is not None:
            points = 1 + commas[node] + min(node.length / 100, 3.0)
            node.parent.points += points
            if node.parent.parent is not None:
                node.parent.parent.points += points / 2
    for node in nodes:
        node.points *= 1 - (node.linked / node.length if node.length else 0)
    return nodes


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the blocks below a node, in page order."""
    current: list[str] = []

    def end() -> None:
        text = "".join(current)
        text = " ".join((unescape(text) if "&" in text else text).split())
        current.clear()
        if text:
            out.append(text)

    waiting: list[Node | str | None] = [node]
    while waiting:
        item = waiting.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            current.append(item)
        elif item.dropped and item is not node:
            continue
        elif item.tag == "br":
            current.append(" ")
        else:
            block = item.tag in BLOCKS
            if block:
                end()
                waiting.append(None)
            waiting += reversed(item.children)
    end()


def _whole(best: Node) -> Node:
    """The outermost article or main element around the best container, or the container itself. What stands beside the container in it is
    text of its own, however short; only what consists mostly of links is dropped, unless it is a heading."""
    top = node = best
    while node is not None:
        if node.tag in ("article", "main"):
            top = node
        node = node.parent
    node = best
    while node is not top:
        for sibling in node.parent.children:
            if isinstance(sibling, Node) and sibling is not node and sibling.tag not in HEADINGS:
                sibling.dropped |= sibling.length > 0 and sibling.linked >= 0.5 * sibling.length
        node = node.parent
    return top


def _drop_unlikely(root: Node) -> None:
    """Drops elements whose names say that they are no article. Elements around the longest article or main element stay, and
    all stay if no paragraph would be left."""
    nodes = _order(root)
    length: dict[Node, int] = {}
    for node in reversed(nodes):
        own = (len(child) if isinstance(child, str) else length.get(child, 0) for child in node.children)
        length[node] = sum(own)
    articles = [node for node in nodes if node.tag in ("article", "main") and not node.unlikely]
    node = max(articles, key=length.__getitem__, default=None)
    while node is not None:
        node.unlikely, node = False, node.parent
    dropped = [node for node in nodes if node.unlikely and node.tag not in ("article", "main")]
    for node in dropped:
        node.dropped = True
    if not any(node.tag in SCORED and length[node] for node in _order(root)):
        for node in dropped:
            node.dropped = False


def main_text(html: str | None) -> str:
    """The blocks of the main text, one to a line; empty if there are none."""
    if not html:
        return ""
    root = parse(html)
    _drop_unlikely(root)
    nodes = _score(root)
    holders = [n for n in nodes if n.length and (n.tag in BLOCKS) and n.tag not in SCORED]
    if not holders:
        return ""
    best = max(holders, key=lambda n: n.points)
    top = _whole(best)
    if top.parent is None:
        kept = [top]
    else:
        least = max(10.0, best.points * 0.2)
        kept = []
        beside = [child for child in top.parent.children if isinstance(child, Node) and not child.dropped]
        # The title and what follows it up to the container are the article's own, however short.
        titles = [place for place, child in enumerate(beside[: beside.index(top)]) if child.tag in ("h1", "h2")]
        lead = beside[titles[-1] : beside.index(top)] if titles else []
        for sibling in top.parent.children:
            if sibling is top:
                kept.append(top)
            elif sibling in lead and (sibling.tag in HEADINGS or sibling.tag == "p" and sibling.linked < 0.25 * sibling.length):
                kept.append(sibling)
            elif isinstance(sibling, Node) and not sibling.dropped and sibling.length:
                density = sibling.linked / sibling.length
                prose = sibling.tag == "p" and sibling.length > 80 and density < 0.25
                if prose or sibling.points >= least and density < 0.5:
                    kept.append(sibling)
    out: list[str] = []
    for node in kept:
        _blocks(node, out)
    return "\n".join(out)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null or empty html and pages without text give an empty text. Comments, scripts and styles are never text; character references are
    decoded; white space inside a block becomes one space. Repeated rows give equal texts; an empty table gives no rows. Columns of
    other names are ignored.
    """
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = dict(source.dtypes)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(value) for value in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return source.mapInPandas(extract, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
