"""Main text of HTML pages by composite text density.

A page is parsed into a tree with the implied end tags of HTML. Elements that are never article text by their tag or an unmistakable
name (scripts, forms, navigation, footers, adverts, comments, ...) are cut out. For every block element the composite text density is
computed: characters per tag, adjusted by the share of linked characters and tags against the page's share. The densities of a
block's children are summed; the block with the greatest sum is the core. The threshold is the least density on the path from the
core up to the body:

- An element whose name is an ordinary word that often, but not always, stands for a part beside the article (share, legal,
  related, notice, ...) goes only if its density says so as well: below the threshold inside of an article; elsewhere if it holds less
  than half of the page's unlinked text.
- Blocks beside the path whose density reaches the threshold belong to the text, and so do headings and text that lies directly
  in an element on the path, apart from runs of nothing but links and signs between them.
- If the core lies in an <article> or <main>, the outermost of these bounds the text: everything in it is text but what the first
  rule drops, and outside of it only other articles that reach the threshold are.

Text: character references decoded, white space inside a block made one space and trimmed, blocks joined in page order by \\n.

Edge cases: null and empty pages give ''; markup that is cut off, unclosed or misnested is read as far as it goes, without
recursion; a page without tags is one block; a very long page costs time in proportion to its length; equal rows are each
extracted; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread

# Element names by their role in HTML, and the words that name parts beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style textarea title noscript iframe template head form button select option nav footer aside menu svg canvas object embed audio video map dialog datalist fieldset noembed noframes".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle adbox adslot banner sponsor sponsored promo "
    "sidebar aside nav navbar navbox mainnav subnav navigation breadcrumb breadcrumbs crumbs topbar toolbar masthead header footer pagination pager "
    "comment comments commentlist commentbox disqus cookie cookies consent gdpr popup modal overlay newsletter subscribe".split()
)
# Ordinary words: a part so named is beside the article only if its density says so too.
ORDINARY_WORDS = frozenset(
    "rail menu promotion promoted reply replies respond responds response responses discussion notice notices notification alert signup login "
    "subscription search share sharing social related recommended recommendations teaser widget copyright legal disclaimer skip hidden".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LAYOUT_WORDS = frozenset("no has with without".split())
COMMENT_WORDS = frozenset("comment reply".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "thead", "tfoot"), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
SCOPE = frozenset("html body article section div main table td th ul ol dl form nav aside header footer blockquote button".split())

MARKUP = re.compile(r"<!--|<!\[CDATA\[|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?")
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
TOKEN = re.compile(r"[a-z0-9]+")
ARTICLE, TITLE = 1, 2
#: No element's name: a block of the text that lies directly in an element.
RUN = "#run"


class Node:
    __slots__ = ("attributes", "children", "density", "density_sum", "chars", "holds", "inside", "link_chars", "link_tags", "ordinary", "parent", "tag", "tags")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.inside = self.ordinary = False  # inside of an article; named by an ordinary word
        self.holds = 0  # ARTICLE, TITLE: what is below


def parse(page: str) -> Node:
    root = node = Node("html", "", None)
    at, n = 0, len(page)
    lower = None
    while at < n:
        found = MARKUP.search(page, at)
        if not found:
            node.children.append(page[at:])
            break
        if found.start() > at:
            node.children.append(page[at : found.start()])
        at = found.end()
        close, tag, attributes = found.groups()
        if tag is None:
            if (mark := found.group()) in ("<!--", "<![CDATA["):
                end = page.find("-->" if mark == "<!--" else "]]>", at)
                at = n if end < 0 else end + 3
            continue
        tag = tag.lower()
        if close:
            node = _closed(node, tag)
        elif tag in ("html", "body"):
            if tag == "body":
                body = Node("body", attributes, root)
                root.children.append(body)
                node = body
        else:
            node = _implied(node, tag)
            child = Node(tag, attributes, node)
            node.children.append(child)
            if tag in RAW:
                lower = page.lower() if lower is None else lower
                if len(lower) != n:  # lower-casing changed positions
                    end = next((x.start() for x in re.finditer(rf"(?i)</{tag}", page[at:])), -1)
                    end = end if end < 0 else end + at
                else:
                    end = lower.find(f"</{tag}", at)
                at = n if end < 0 else (page.find(">", end) + 1 or n)
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                node = child
            elif tag not in VOID and tag not in ("path", "circle", "rect", "use", "g", "line", "polygon"):
                node = child  # a slash does not end an HTML element
    return root


def _closed(node: Node, tag: str) -> Node:
    if tag in ("html", "body") or tag in VOID:
        return node
    x = node
    while x.parent is not None and x.tag != tag:
        if x.tag == "body" or (tag in INLINE or tag == "p") and x.tag in SCOPE:
            return node  # nothing of that name is open here
        x = x.parent
    return x.parent if x.parent is not None and x.tag == tag else node


def _implied(node: Node, tag: str) -> Node:
    """Where a start tag lands after the end tags that it implies."""
    if tag in CLOSES_P:
        x = node
        while x.tag not in SCOPE and x.tag != "p" and x.parent is not None:
            x = x.parent
        if x.tag == "p":
            node = x.parent
        elif tag[0] == "h" and tag[1:].isdigit() and node.tag[0] == "h" and node.tag[1:].isdigit():
            node = node.parent
    if tag in SAME_CLOSES:
        ends, x = SAME_CLOSES[tag], node
        stop = ("ul", "ol", "dl", "table", "select", "body", "html", "article")
        last = None
        while x.tag not in stop and x.parent is not None:
            if x.tag in ends:
                last = x
            x = x.parent
        if last is not None:
            node = last.parent
    return node


def _names(node: Node) -> set[str] | None:
    """The words of an element's classes and identifier; None if an attribute hides it or gives it a role beside the article."""
    words: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(node.attributes) if node.attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "role" and value in SIDE_ROLES:
            return None
        if name in ("class", "id"):
            for own in map(set, map(TOKEN.findall, value.split())):
                if not own & LAYOUT_WORDS:
                    words |= own
    return words


def _beside(node: Node) -> bool:
    """Whether an element is no article text by its tag, role or an unmistakable name; notes whether it has an ordinary one."""
    tag = node.tag
    if tag in NEVER:
        return True
    if tag in ("body", "html", "main"):
        return False
    if (words := _names(node)) is None:
        return True
    if tag == "article":
        return bool(words & (SIDE_WORDS if node.inside else COMMENT_WORDS))
    if tag in HEADINGS:
        words -= {"header", "masthead"}
    elif tag == "header" or words & {"header", "masthead"}:
        if not (node.inside and node.holds & TITLE):
            return True
        words -= {"header", "masthead"}
    if not words & (SIDE_WORDS | ORDINARY_WORDS) or node.holds & ARTICLE:
        return False
    node.ordinary = not words & SIDE_WORDS
    return not node.ordinary


def _note_contents(root: Node) -> None:
    """Notes for every element whether an article or a title is below it, in one pass."""
    for node in reversed(_below(root)):
        for x in node.children:
            if not isinstance(x, str):
                node.holds |= x.holds | (ARTICLE if x.tag in ("article", "main") else TITLE if x.tag in ("h1", "h2") else 0)


def _pruned(root: Node) -> list[Node]:
    """Cuts out what is never article text; all remaining elements, parents first."""
    _note_contents(root)
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        for x in node.children:
            if not isinstance(x, str):
                x.inside = node.inside or node.tag in ("article", "main")
        node.children = [x for x in node.children if isinstance(x, str) or not _beside(x)]
        order.append(node)
        todo.extend(x for x in node.children if not isinstance(x, str))
    return order


def _below(top: Node) -> list[Node]:
    """An element and all below it, parents first."""
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.children if not isinstance(x, str))
    return order


def _without_named(order: list[Node], body: Node) -> list[Node]:
    """Cuts out what has an ordinary name, lies in no article and holds less than half of the page's unlinked text."""
    small = {id(x) for x in order if x.ordinary and not x.inside and 2 * (x.chars - x.link_chars) < body.chars - body.link_chars}
    if not small:
        return order
    for x in order:
        x.children = [y for y in x.children if isinstance(y, str) or id(y) not in small]
    order = _below(body)
    _measure(order, body)
    return order


def _measure(order: list[Node], body: Node) -> None:
    """Characters, tags and link shares of every element, then composite densities and their sums over child blocks."""
    for node in reversed(order):
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(x) - x.count(" ") - x.count("\n")
            else:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, lc, t, lt = node.chars, max(1, node.link_chars), max(1, node.tags), max(1, node.link_tags)
        if not c:
            node.density = 0.0
            continue
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
        node.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else math.log(max(1.0, c / lc * t / lt)))
    for node in order:
        node.density_sum = sum(x.density for x in node.children if not isinstance(x, str) and x.tag not in INLINE)


def _core(order: list[Node], body: Node) -> tuple[Node | None, list[Node]]:
    """The block with the greatest sum of densities, and the path from it to the body."""
    blocks = [x for x in order if x.tag not in INLINE and x.chars and (x is body or x.tag not in ("html", "head"))]
    if not blocks:
        return None, []
    x = core = max(blocks, key=lambda x: x.density_sum)
    path = [core]
    while x is not body and x.parent is not None:
        x = x.parent
        path.append(x)
    return core, path


def _chosen(order: list[Node], body: Node) -> list[Node]:
    """The elements whose text is the article, in page order."""
    core, path = _core(order, body)
    if core is None:
        return []
    threshold = min(x.density for x in path)
    bounds = [x for x in path if x.tag in ("article", "main")]
    for x in order:  # inside of an article a name needs a low density beside it
        x.children = [y for y in x.children if isinstance(y, str) or not (y.ordinary and y.inside and y.density < threshold)]
    on_path, out, todo = set(map(id, path)), [], [path[-1]]
    while todo:
        node = todo.pop()
        if node is core or bounds and node is bounds[-1]:
            out.append(node)
        elif id(node) in on_path:
            todo.extend(reversed(_runs(node, on_path)))
        elif bounds:
            todo.extend(reversed([x for x in node.children if not isinstance(x, str)]) if node.tag != "article" else ())
            if node.tag == "article" and node.chars and node.density >= threshold:
                out.append(node)
        elif node.tag == RUN or node.chars and (node.density >= threshold or node.tag in HEADINGS):
            out.append(node)
    return out


def _says(parts: list) -> bool:
    """Whether there is a letter or digit outside of links."""
    todo = list(parts)
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if any(map(str.isalnum, html.unescape(x))):
                return True
        elif x.tag != "a":
            todo.extend(x.children)
    return False


def _runs(node: Node, on_path: set[int]) -> list[Node]:
    """The children of an element, with its own text and inline elements gathered to runs; runs of nothing but links and signs between them stay apart."""
    out: list[Node] = []
    own: list = []

    def flush() -> None:
        if _says(own):
            run = Node(RUN, "", node)
            run.children = own.copy()
            out.append(run)
        else:
            out.extend(x for x in own if not isinstance(x, str))
        own.clear()

    for x in node.children:
        if isinstance(x, str) or x.tag in INLINE and id(x) not in on_path:
            own.append(x)
        else:
            flush()
            out.append(x)
    flush()
    return out


def _lines(node: Node) -> list[str]:
    """Blocks of text below a node, in page order."""
    lines: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            if line := " ".join(html.unescape("".join(parts)).split()):
                lines.append(line)
            parts.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag in ("br", "wbr", "img"):
            parts.append(" " if x.tag == "br" else "")
        elif x.tag in INLINE:
            todo.extend(reversed(x.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return lines


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    order = _pruned(root)
    body = next((x for x in order if x.tag == "body"), root)
    if body is not root:
        order = _below(body)
    _measure(order, body)
    order = _without_named(order, body)
    return "\n".join(line for x in _chosen(order, body) for line in _lines(x))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    out = spread(rows).mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(key), F.col("url").alias(url), "text", "n_chars")
