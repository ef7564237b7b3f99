"""Main text of web pages by tree scoring.

A tolerant reader builds a tree. Elements that are never part of an article go: by tag, by role, or by the words of
class and id. Then every paragraph gives points for its length and its commas to its parent, and half of them to the
grandparent; an element's points are discounted by its link density. The best container is kept, widened to the
article or main element around it, with those siblings that score well themselves (several articles of a page as well).
Its blocks are the result. Lists of links go, but for those between the paragraphs of an article.

Defined cases: null and empty pages give an empty text; unclosed tags, quotes and comments end with the page; pages
of any length and nesting are taken whole, in linear time; nothing is capped; of containers of equal score the first
is the best; repeated rows get equal results; an empty table gives an empty table; input columns named like an output
column are replaced by it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foldlog.llm.common import map_texts, rows_of

OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

# Elements of HTML by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math canvas audio video object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset(("br", "td", "th", "img", "wbr", "input"))
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr"}
#: A start tag closes an open element of these kinds, up to the nearest of the others.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
SCOPES = frozenset("table td th caption button object html body article main section".split())
NEVER = frozenset("nav footer aside form dialog menu select option button input label fieldset datalist head search map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id that mark what isn't article text.
UNLIKELY = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation navi newsletter notice "
    "notices notification overlay pager pagination popup promo promotion promos related replies reply respond share sharing shoutbox sidebar sidenav "
    "signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
#: These go even if an article element stands inside: readers' comments are often marked up as articles.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies respond".split())
HOLDERS = frozenset(("article", "main"))
BONUS = 25
LISTS = frozenset(("ul", "ol", "div", "table", "section", "dl"))
GOOD = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.I)

TOKEN = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"?[^>"']*|'[^']*'?[^>"']*)*)>?|[!?][^>]*>?|/[^>]*>?)""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in RAW}


class Node:
    """An element; ``parts`` holds texts and elements in order."""

    __slots__ = ("anchors", "gone", "hints", "inside", "links", "parent", "parts", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, hints: str = ""):
        self.tag, self.parent, self.hints, self.parts = tag, parent, hints, []
        self.size = self.links = self.anchors = 0
        self.score, self.gone, self.inside = 0.0, False, False


def _hidden(raw: str) -> tuple[str, bool]:
    """Class and id of an attribute string, and whether role or state rule the element out."""
    names, out = [], False
    for m in ATTRIBUTE.finditer(raw):
        key = m[1].lower()
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        if key in ("class", "id"):
            names.append(value)
        elif key == "role":
            out = out or value.strip().lower() in ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            out = True
        elif key == "style":
            style = value.replace(" ", "").lower()
            out = out or "display:none" in style or "visibility:hidden" in style
    return " ".join(names), out


def parse(page: str) -> list[Node]:
    """All elements in the order of their start tags; the first is the root."""
    root = Node("html", None)
    nodes, stack, at, n = [root], [root], 0, len(page)
    find = TOKEN.search
    still: Counter[str] = Counter()  # open elements by tag: no search for one that isn't there

    def cut_at(k: int) -> None:
        still.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = find(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = n if end < 0 else end + 3
            continue
        tag = name.lower()
        if m[1]:  # an end tag closes the nearest open element of its name
            for k in range(len(stack) - 1, 0, -1) if still[tag] > 0 else ():
                if stack[k].tag == tag:
                    cut_at(k)
                    break
                if stack[k].tag in SCOPES and tag not in SCOPES and tag not in BLOCK:
                    break
            if tag == "p" or tag == "br":
                stack[-1].parts.append(" ")
            continue
        if tag in RAW:
            end = None if m[3].endswith("/") and tag in ("svg", "math") else RAW_END[tag].search(page, at)
            if end is not None:
                close = page.find(">", end.end())
                at = n if close < 0 else close + 1
            elif not m[3].endswith("/"):
                at = n
            continue
        if tag in ("html", "body"):
            if m[3]:
                stack[0].hints += " " + _hidden(m[3])[0]
            if tag == "body":
                cut_at(1)
            continue
        if tag in SIBLINGS:
            same, stop = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(still[t] > 0 for t in same) else ():
                if stack[k].tag in same:
                    cut = k
                    while cut > 1 and stack[cut - 1].tag in same:
                        cut -= 1
                    cut_at(cut)
                    break
                if stack[k].tag in stop:
                    break
        if tag in CLOSES_P and still["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut_at(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        hints, out = _hidden(m[3]) if m[3] and not m[3].isspace() else ("", False)
        node = Node(tag, stack[-1], hints)
        node.gone = out or tag in NEVER
        stack[-1].parts.append(node)
        nodes.append(node)
        if tag not in VOID and not m[3].endswith("/") or tag in BLOCK and tag not in VOID:
            stack.append(node)
            still[tag] += 1
    return nodes


def _names(node: Node) -> list[str]:
    return [x.lower() for x in NAME_PART.findall(node.hints)]


def _measure(nodes: list[Node]) -> None:
    """Text and link sizes of all elements, those that are gone not counted. Children come after parents."""
    for node in nodes:
        node.size = node.links = node.anchors = 0
        node.inside = node.tag in HOLDERS
    for node in reversed(nodes):
        if node.gone:
            node.size = node.links = node.anchors = 0
            continue
        node.anchors += node.tag == "a"
        node.size += sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        if node.tag == "a":
            node.links = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
            node.parent.anchors += node.anchors
            node.parent.inside |= node.inside


def prune(nodes: list[Node]) -> list[Node]:
    """Mark what isn't article text; give the elements that are left."""
    forms = [x for x in nodes if x.tag == "form" and x.gone]
    for x in forms:
        x.gone = False
    _measure(nodes)
    total = nodes[0].size
    for x in forms:  # a form around the whole page is none of its own
        x.gone = not x.inside and x.size <= 0.5 * total
    within: set[int] = set()
    for x in nodes[1:]:
        parent = x.parent
        if x.gone or parent.gone:
            x.gone = True
            continue
        if parent.tag in HOLDERS or id(parent) in within:
            within.add(id(x))
        if x.tag in HOLDERS and not x.hints or not x.hints and x.tag != "header":
            continue
        names = _names(x)
        if not COMMENTS.isdisjoint(names):
            x.gone = x.tag != "main"
        elif x.tag == "header" or not UNLIKELY.isdisjoint(names):
            # A name may describe the layout of what it holds: not so for an article, or for most of the page.
            if x.tag not in HOLDERS and (x.inside or x.tag != "header" and x.size > 0.6 * total):
                continue
            headed = any(isinstance(c, Node) and c.tag in ("h1", "h2") for c in x.parts)
            x.gone = not (id(x) in within and headed and "header" in (x.tag, *names))
    _measure(nodes)
    own = _between_paragraphs(nodes, within)
    for x in nodes[1:]:  # lists of links
        if x.parent.gone:
            x.gone = True
        elif x.tag in LISTS and x.size and x.links > 0.8 * x.size and x.anchors >= 3 and id(x) not in own:
            x.gone = True
    left = [x for x in nodes if not x.gone]
    _measure(nodes)
    return left


def _between_paragraphs(nodes: list[Node], within: set[int]) -> set[int]:
    """Lists in an article that stand between its paragraphs: what they link to is part of the article."""
    own: set[int] = set()
    for parent in nodes:
        if parent.gone or not (parent.tag in HOLDERS or id(parent) in within):
            continue
        parts = [c for c in parent.parts if isinstance(c, Node) and not c.gone]
        plain = [k for k, c in enumerate(parts) if c.tag == "p" and c.size > 2 * c.links]
        if plain:
            own.update(id(c) for c in parts[plain[0] : plain[-1]] if c.tag in ("ul", "ol", "dl", "table"))
    return own


def container(nodes: list[Node]) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    for x in nodes:
        x.score = 0.0
    for x in nodes:
        own = "".join(p for p in x.parts if isinstance(p, str)) if x.tag not in ("p", "pre", "blockquote") else None
        if own is not None and (x.tag in ("a", "html") and not own.strip() or not own.strip()):
            continue
        size = x.size if own is None else len(own.strip())
        if not size:
            continue
        commas = sum(p.count(",") for p in x.parts if isinstance(p, str))
        points = (1 + commas + min(size / 100, 3)) * (1 - (x.links / x.size if x.size else 0))
        to = x if own is not None and x.tag in BLOCK and x.tag not in ("p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt") else x.parent or x
        to.score += points
        if to.parent is not None:
            to.parent.score += points / 2
    best, most = nodes[0], -1.0
    for x in nodes:
        if x.tag in BLOCK or x.tag in ("td", "html", "span"):
            score = x.score * (1 - (x.links / x.size if x.size else 0))
            score += (BONUS if x.tag in HOLDERS else 5 if GOOD.search(x.hints) else 0) * (x.size > 0)
            x.score = score
            if score > most:
                best, most = x, score
    around = best
    while around is not None and around.tag not in HOLDERS:
        around = around.parent
    best = around or best
    while best.parent is not None and best.parent.tag in HOLDERS:
        best = best.parent
    if best.parent is None:
        return [best]
    kept = []
    for x in best.parent.parts:
        if not isinstance(x, Node) or x.gone:
            continue
        dense = x.links / x.size if x.size else 1.0
        likely = x.score >= max(10.0, 0.3 * most) and x.tag in BLOCK
        paragraph = x.tag in ("p", "blockquote", "pre") and x.size > 80 and dense < 0.25
        beside = best.tag in HOLDERS and x.tag in HOLDERS and dense < 0.5 and x.score - BONUS >= 0.2 * (best.score - BONUS)
        if x is best or beside or best.tag not in HOLDERS and dense < 0.5 and (likely or paragraph or x.tag in ("h1", "h2")):
            kept.append(x)
    return kept


def blocks(top: Sequence[Node]) -> list[str]:
    """Texts of the blocks under some elements, white space made one space each, empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            line = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if line:
                out.append(line)

    for root in top:
        flush()
        waiting: list = [iter((root,))]
        ends: list[Node | None] = [None]
        while waiting:
            x = next(waiting[-1], None)
            if x is None:
                waiting.pop()
                done = ends.pop()
                if done is not None and done.tag in BLOCK:
                    flush()
                elif done is not None and done.tag in SPACED:
                    held.append(" ")
            elif isinstance(x, str):
                held.append(x)
            elif not x.gone:
                if x.tag in BLOCK:
                    flush()
                elif x.tag in SPACED:
                    held.append(" ")
                waiting.append(iter(x.parts))
                ends.append(x)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    left = prune(parse(page))
    if not left or not left[0].size:
        return ""
    return "\n".join(blocks(container(left)))


def extract(pages: DataFrame, carry: Sequence[str] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``text`` and ``n_chars`` of each page."""

    def make():
        def apply(texts):
            found = [main_text(t) for t in texts]
            return rows_of(2, [(t, len(t)) for t in found])

        return apply

    return map_texts(pages, carry, html_col, make, OUT)
