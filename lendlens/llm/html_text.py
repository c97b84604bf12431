"""HTML extraction by tree scoring.

A page becomes a tree (unclosed and stray tags are tolerated). Parts that are no
article by kind or by name (menus, headers and footers of the page, sidebars,
notices, adverts, forms, comments, scripts, styles) are left out. Every remaining
paragraph passes points for its length and commas to the containers above it, the
full sum to its parent, half to the next and less beyond; a container's points are
discounted by its share of linked text. The best container is kept, with the
siblings that carry points of their own or head it, or the whole article element
around it. Its blocks are joined in page order.

Each page is one row of an Arrow batch: no shuffle, and memory of one batch. The
tokeniser and the tree walk are linear and free of recursion.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
DROPPED = set(
    "head script style noscript template nav footer aside form button select option input textarea iframe object embed "
    "svg math canvas audio video dialog menu map applet title link meta noembed noframes xmp fieldset".split()
)
NAMES = set(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup sidebar sidenav aside rail menu menubar nav navbar navigation topnav breadcrumb breadcrumbs topbar toolbar header "
    "masthead footer foot copyright comment comments commentlist disqus respond replies reply discussion related "
    "recommended share sharing social widget widgets login search pagination pager skip teaser outbrain taboola".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD = set("article body content entry hentry main post story text blog prose".split())
#: Parts of layout names ("with-sidebar", "content-sidebar-wrap") that tell of what is around.
AROUND = set("has with without no is wrap wrapper container layout grid".split())
#: A start tag of the set ends an open element of the name.
CLOSED_BY = {
    "p": BLOCKS - {"body", "html"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
    "head": {"body"},
}
#: Elements that an unclosed element inside doesn't reach out of.
FENCES = {"td", "th", "table", "html", "body", "article", "section", "main", "div", "ul", "ol", "dl", "blockquote", "button"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>?")
_OTHER = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_WANTED = {"class", "id", "role", "hidden", "style", "aria-hidden", "itemprop"}


class Node:
    __slots__ = ("name", "names", "junk", "holds", "attributes", "parent", "children")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        tokens = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
        self.names: set[str] = set()
        self.junk: set[str] = set()  # name parts that tell of no article
        self.holds = False  # an article or main element lies inside
        for token in tokens:
            parts = {x.lower() for x in _NAME_PARTS.findall(token)}
            self.names |= parts
            if not parts & AROUND:
                self.junk |= parts & NAMES
        self.children: list[Node | str] = []


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for m in _ATTRIBUTE.finditer(source):
        name = m[1].lower()
        if name in _WANTED and name not in found:
            found[name] = html.unescape(m[2] or m[3] or m[4] or "")
    return found


def parse(source: str) -> Node:
    """The page's tree; text is decoded, comments and doctypes are left out."""
    root = Node("html", {}, None)
    here, at, size = root, 0, len(source)
    opened: dict[str, int] = {}

    def close(to: Node) -> Node:
        nonlocal here
        while True:
            opened[here.name] = opened.get(here.name, 1) - 1
            left, here = here, here.parent
            if left is to:
                return here

    while at < size:
        sign = source.find("<", at)
        if sign != at:
            here.children.append(html.unescape(source[at : sign if sign >= 0 else size]))
            at = sign if sign >= 0 else size
            continue
        m = _TAG.match(source, at)
        if m is None:
            m = _OTHER.match(source, at)
            if m is None:
                here.children.append("<")
            at = m.end() if m else at + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if opened.get(name, 0) > 0:
                to = here
                while to.name != name:
                    to = to.parent
                close(to)
            continue
        if name in ("html", "body") and (name == "html" or opened.get("body", 0)):
            root.attributes.update(_attributes(m[3]))
            continue
        to = here
        while to is not root:
            if name in CLOSED_BY.get(to.name, ()):
                close(to)
                break
            if to.name in FENCES:
                break
            to = to.parent
        node = Node(name, _attributes(m[3]) if m[3] else {}, here)
        here.children.append(node)
        if name in ("article", "main") and not node.junk & _NO_ARTICLE:
            above = here
            while above is not None and not above.holds:
                above.holds, above = True, above.parent
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            at = size if end is None else (source.find(">", end.end()) + 1 or size)
        elif name not in VOID and not m[3].endswith("/") or name in ("p", "div", "article", "section"):
            opened[name] = opened.get(name, 0) + 1
            here = node
    return root


def _dropped(node: Node, in_article: bool) -> bool:
    """Whether a part is no article by its kind or name."""
    if node.name in DROPPED:
        return True
    if node.name in ("html", "body"):
        return False
    if node.name == "header" and not in_article:
        return True
    a = node.attributes
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    if "style" in a and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.I):
        return True
    if node.holds or node.name in ("article", "main"):
        return bool(node.junk & _NO_ARTICLE) and not node.holds
    found = set(node.junk)
    if node.name in _TEXTUAL or node.names & _HEADED:
        found -= {"header", "text", "body"}  # as in class="article-header"
    return bool(found)


#: Elements that hold text themselves, names whose header belongs to the article, and names
#: of article elements that are none.
_TEXTUAL = {"h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong", "span", "code", "p"}
_HEADED = {"article", "post", "entry", "story"}
_NO_ARTICLE = set("comment comments reply replies ad ads advert advertisement sponsored promo teaser related".split())


class Page:
    """The kept part of a page: blocks of text with the container each lies in."""

    def __init__(self, source: str):
        self.blocks: list[tuple[Node, str, int]] = []  # innermost block element, text, linked characters
        parts: list[str] = []
        linked = 0
        inside = None

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                self.blocks.append((inside, text, min(linked, len(text))))
            linked = 0

        root = parse(source)
        stack: list[tuple[Node, int, Node, bool, bool]] = [(root, 0, root, False, False)]
        inside = root
        while stack:
            node, k, block, link, article = stack.pop()
            if k == 0 and node.name in BLOCKS:
                flush()
                block = node
            inside = block
            resumed = False
            while k < len(node.children):
                child = node.children[k]
                k += 1
                if isinstance(child, str):
                    parts.append(child)
                    linked += len(child.strip()) if link else 0
                elif child.name in VOID:
                    if child.name in BLOCKS:
                        flush()
                    parts.append(" " if child.name == "br" else "")
                elif _dropped(child, article):
                    parts.append(" " if child.name in ("button", "select") else "")
                    if child.name in BLOCKS:
                        flush()
                else:
                    stack.append((node, k, block, link, article))
                    stack.append((child, 0, block, link or child.name == "a", article or child.name in ("article", "main")))
                    resumed = True
                    break
            if not resumed and node.name in BLOCKS:
                flush()
                inside = _block_of(node.parent) or root
        flush()
        self.root = root


def _block_of(node: Node | None) -> Node | None:
    while node is not None and node.name not in BLOCKS:
        node = node.parent
    return node


_PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "th", "caption", "summary", "address", "legend", "tr"}


def points(text: str) -> float:
    """A paragraph's points: one, one a comma, and up to three for its length."""
    return 1.0 + text.count(",") + text.count("،") + text.count("，") + min(len(text) / 100, 3.0)


def _above(block: Node) -> Iterator[Node]:
    """The containers of a block, from the inside."""
    node = block.parent if block.name in _PARAGRAPHS and block.parent is not None else block
    while node is not None:
        if node.name in BLOCKS and node.name not in _PARAGRAPHS:
            yield node
        node = node.parent


def extract(source: str) -> str:
    """The main text of a page; empty if it has none."""
    page = Page(source)
    score: dict[Node, float] = {}
    chars: dict[Node, list[int]] = {}
    for block, text, linked in page.blocks:
        own = points(text) if block.name not in ("h1", "h2", "h3", "h4", "h5", "h6") else 0.0
        for level, node in enumerate(_above(block)):
            counted = chars.setdefault(node, [0, 0])
            counted[0] += len(text)
            counted[1] += linked
            if level < 6:
                score[node] = score.get(node, 0.0) + own / (1 if level == 0 else 2 if level == 1 else 3 * level)
    if not score:
        return ""
    final = {}
    for node, value in score.items():
        bonus = 25.0 * (node.name in ("article", "main") or node.attributes.get("role") == "main" or node.attributes.get("itemprop") == "articleBody")
        bonus += 10.0 * bool(node.names & GOOD) if node.name != "body" else 0.0
        total, linked = chars[node]
        final[node] = (value + bonus * (value > 0)) * (1.0 - linked / max(total, 1))
    best = max(final, key=final.__getitem__)
    kept = _widen(best, final, chars)
    out = []
    for block, text, _ in page.blocks:
        node = block
        while node is not None and node not in kept:
            node = node.parent
        if node is not None:
            out.append(text)
    return "\n".join(out)


def _widen(best: Node, final: dict[Node, float], chars: dict[Node, list[int]]) -> set[Node]:
    """The best container with what belongs to it: the article element around it, else
    itself and the siblings with a fifth of its points or, unlinked, text of their own."""
    node = best
    while node is not None:
        if node.name in ("article", "main") or node.attributes.get("role") == "main":
            return {node}
        node = node.parent
    kept, parent = {best}, best.parent
    if parent is None or best.name in ("body", "html"):
        return kept
    for sibling in parent.children:
        if not isinstance(sibling, Node) or sibling is best:
            continue
        total, linked = chars.get(sibling, (0, 0))
        if sibling.name in _PARAGRAPHS or (
            final.get(sibling, 0.0) >= max(4.0, 0.2 * final[best]) and linked <= 0.25 * total
        ):
            kept.add(sibling)
    return kept


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every whole page.

    Input: columns page_id, url, html; others are ignored. A null or empty html gives
    an empty text; repeated rows give repeated results.
    """
    common.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            values = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(values, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_or_empty("html").alias("html")
    )
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.read(spark, sf_dir, "pages", ["page_id", "url", "html"]))
