"""Main text of web pages by composite text density.

For every block node of the tree, characters per tag are computed and lowered by the share of link characters and
link tags in the node and in the page (density).  A node's sum is that of its children's densities (a leaf's is its
own); the node with the largest sum is the core.  The smallest density on the path from the body to the core is the
threshold: blocks beside that path that reach it and hold prose of their own (paragraphs, headings, lists, tables,
sections) belong to the article as well.

Removed before that, with all they hold: scripts, styles, forms, menus, page headers, footers, asides, embedded
objects, hidden parts, and elements whose class, id or role names them as advert, notice, sidebar, comments and the
like (whole class tokens; ids as a whole, not of headings or of sections of an article).  A name is weighed against
the text: a form or a named element without which almost nothing of the page is left is its wrapper and stays.
Character references are decoded, white space inside a block becomes one space, blocks are joined by one.

Defined results: null, empty and text-free pages give an empty text; a page that breaks off in a tag, a comment or
a script is read up to there; a head without end tag ends at the first tag or text of a body; depth is not limited;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docketry.llm.common import read, small_batches, text_slices

# Fixed values of the HTML language and of common page templates.
RAW_TEXT = "script style noscript template svg textarea title iframe object math canvas"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup "
    "time tt u var img wbr picture source track area label".split()
)
REMOVED = frozenset("nav footer aside button select menu dialog input audio video map head".split())
HEAD_ONLY = frozenset("meta link base".split())
WRAPPERS = frozenset("form fieldset".split())  # removed, unless they wrap the page
CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure section article main".split())
NAMED_REMOVED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay sidebar aside menu menus nav navbar navigation topnav breadcrumb breadcrumbs footer masthead comment comments "
    "commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login form search "
    "pagination pager toolbar widget widgets skip hidden complementary contentinfo".split()
)
NAMED_REMOVED_OUTSIDE = frozenset({"header"})  # inside an article it holds the article's heading
SAME_KIND = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot article section div main body".split())

_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(?P<raw>{'|'.join(RAW_TEXT.split())})(?=[\s/>])(?:[^>]*+>|\Z).*?(?:</(?P=raw)\s*+>|\Z)
    |<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)
    |<(?:[!?][^>]*+|/[^>]*+)(?:>|\Z)
    |<\Z""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORTH_READING = re.compile(r"class|id|role|hidden|style", re.I)
_STYLE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What becomes of an element: it stays, it goes unless it wraps the page, or it goes.
STAYS, NAMED, GOES = range(3)
#: A named element wraps the page if what is left without it is less than this part of its text; comments need less.
LEFT, LEFT_BY_COMMENTS = 1 / 4, 1 / 20
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "start", "end", "density", "total", "fate", "comments", "nested", "prose")

    def __init__(self, tag: str, parent: Node | None, start: int, fate: int = STAYS, comments: bool = False):
        self.tag, self.parent, self.children, self.start, self.end = tag, parent, [], start, start
        self.chars = self.tags = self.link_chars = self.link_tags = self.nested = 0
        self.density = self.total = 0.0
        self.fate, self.comments, self.prose = fate, comments, tag in PROSE
        if parent is not None:
            parent.children.append(self)


def fate_of(tag: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """What becomes of an element by its tag and attributes, and whether its names are those of comments."""
    if tag in REMOVED or (tag == "header" and not in_article):
        return GOES, False
    fate = NAMED if tag in WRAPPERS else STAYS
    if not attrs or tag in ("html", "body", "article", "main") or not _WORTH_READING.search(attrs):
        return fate, False
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value.strip() == "true") or (key == "style" and _STYLE_HIDDEN.search(value)):
            return GOES, False
        if key in ("class", "role"):
            names.update(value.split())
        elif key == "id" and tag not in HEADINGS and not (in_article and tag == "section"):
            names.add(value.strip())
    if names & NAMED_REMOVED or (names & NAMED_REMOVED_OUTSIDE and not in_article):
        fate = NAMED
    return fate, bool(names & COMMENTS)


def parsed(html: str) -> tuple[Node, list[str]]:
    """The tree of block nodes, removed ones included, and the text pieces in page order."""
    root = Node("body", None, 0)
    node, stack, pieces = root, [root], []
    links, articles, at = 0, 0, 0

    def text(part: str) -> None:
        if node.tag == "head" and part.strip():
            close(len(stack) - 1)
        value = unescape(part)
        pieces.append(value)
        n = len(" ".join(value.split()))
        node.chars += n
        if links:
            node.link_chars += n

    def close(depth: int) -> None:
        nonlocal node, articles, links
        while len(stack) > depth:
            done = stack.pop()
            pieces.append(" ")
            done.end = len(pieces)
            articles -= done.tag in ("article", "main")
        node, links = stack[-1], 0

    for m in _MARKUP.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        tag, ending, attrs = name.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if ending:
            if tag in INLINE and node.tag != tag:
                links = max(0, links - 1) if tag == "a" else links
            elif node.tag == tag and node.nested:
                node.nested -= 1
            else:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
            continue
        if node.tag == "head" and tag not in HEAD_ONLY:
            close(len(stack) - 1)
        if tag in ("html", "body"):
            continue
        fate, comments = fate_of(tag, attrs, articles > 0)
        empty = tag in VOID or (fate != STAYS and attrs.endswith("/"))
        if tag in INLINE and (fate == STAYS or empty):
            if node.tag == tag:
                node.nested += 1  # an inline node holds another of its kind
            node.tags += 1
            if tag == "a":
                links += 1
                node.link_tags += 1
            continue
        if empty:
            node.tags += fate == STAYS
            pieces.append(" ")
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in SAME_KIND:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SAME_KIND[tag]:
                    close(depth)
                    break
                if stack[depth].tag in CONTAINERS:
                    break
        if tag not in INLINE:
            pieces.append(" ")
        node = Node(tag, stack[-1], len(pieces), fate, comments)
        stack.append(node)
        articles += tag in ("article", "main")
    if at < len(html):
        text(html[at:])
    close(1)
    root.end = len(pieces)
    return root, pieces


def in_order(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    nodes = [root]
    for n in nodes:
        nodes.extend(n.children)
    return nodes


def decide(root: Node) -> None:
    """Unwrap the page: named elements stay without which almost nothing is left, the largest first."""
    nodes = in_order(root)
    under: dict[int, int] = {}  # characters of a node and below, parts that go in any case left out
    for n in reversed(nodes):
        under[id(n)] = n.chars + sum(under[id(x)] for x in n.children if x.fate != GOES)
    reached = [root]
    for n in reached:
        reached.extend(x for x in n.children if x.fate != GOES)
    named = [n for n in reached if n.fate == NAMED]
    named.sort(key=lambda n: -under[id(n)])  # of equal ones the outermost first

    def kept(n: Node) -> int:
        total, todo = 0, [n]
        for x in todo:
            total += x.chars
            todo.extend(y for y in x.children if y.fate == STAYS)
        return total

    left = kept(root)
    for n in named:
        if left < under[id(n)] * (LEFT_BY_COMMENTS if n.comments else LEFT):
            n.fate = STAYS
            left = kept(root)


def without_removed(root: Node, pieces: list[str]) -> None:
    """Take what goes out of the tree and the pieces."""
    for n in in_order(root):
        for x in n.children:
            if x.fate != STAYS:
                pieces[x.start : x.end] = [""] * (x.end - x.start)
        n.children = [x for x in n.children if x.fate == STAYS]


def measure(root: Node) -> list[Node]:
    """Counts, densities and sums of all nodes; children come after their parents in the list."""
    nodes = in_order(root)
    for n in reversed(nodes):
        if n.parent is not None:
            p = n.parent
            p.chars, p.link_chars = p.chars + n.chars, p.link_chars + n.link_chars
            p.tags, p.link_tags = p.tags + n.tags + 1, p.link_tags + n.link_tags
            p.prose = p.prose or n.prose
    page = root.link_chars / max(root.chars, 1)
    for n in nodes:
        c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
        if c:
            base = log(c / max(c - n.link_chars, 1) * lc + page * c + e)
            n.density = max(0.0, c / t * log(max(c / lc * t / lt, 1.0)) / log(base)) if base > 1 else c / t
    for n in nodes:
        n.total = sum(x.density for x in n.children) if n.children else n.density
    return nodes


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root, pieces = parsed(html)
    decide(root)
    without_removed(root, pieces)
    nodes = measure(root)
    core = max(nodes, key=lambda n: n.total)  # of equal sums the outermost, first in the page
    if core.tag in ("p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "tr", "tbody", "blockquote", "pre") and core.parent is not None:
        core = core.parent
    path, n = [core], core
    while n.parent is not None:
        n = n.parent
        path.append(n)
    threshold = min(n.density for n in path)
    chosen = [core]
    for below, above in zip(path, path[1:]):
        for n in above.children:
            if n is not below and n.chars and n.density >= threshold and 3 * n.link_chars <= n.chars and n.prose:
                chosen.append(n)
    chosen.sort(key=lambda n: n.start)
    return " ".join(" ".join("".join(pieces[n.start : n.end]) for n in chosen).split())


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in text_slices(whole.column(2)):
                batch = whole.slice(a, b - a)
                texts = [main_text(html) for html in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
