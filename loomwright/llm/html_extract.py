"""Main text of HTML pages by tree scoring.

A page is parsed leniently into a tree (unclosed and misnested tags are closed as browsers close them).
Boilerplate goes first: scripts, styles, forms, menus, headers and footers outside an article, sidebars,
and containers whose class, id or role names an advert, a notice, reader comments and the like. Then
every paragraph passes points for its length and commas to its ancestors, half as much with each level;
an element's score is discounted by the share of its text that stands in links. The best container and
those siblings that score well are kept, and the text of their blocks is joined in page order.

Edge cases: a null or empty page gives empty text, as does one without text outside boilerplate; a page
without any tag is one block; unfinished tags, comments and scripts at the end run to the end; repeated
rows are read alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, takes_over

#: An attribute as the HTML standard reads it: quotes mean something only right behind the equals sign.
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?+"""
_ATTR = re.compile(rf"""(=?+[^\s/>=]++|=)(?:{_VALUE})?+""")
_REST = r"""(?:[\s/]++|(?:=?+[^\s/>=]++|=)(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+)*+"""
_TAG = re.compile(rf"""<!--(?:-?>|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_REST})(?:>|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\Z)|</>""", re.S)
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_DROP = {"script", "style", "noscript", "template", "nav", "aside", "form", "button", "select", "option", "textarea", "input", "iframe", "object", "embed", "applet", "canvas", "svg", "math", "audio", "video", "dialog", "menu", "head", "title", "noembed", "noframes", "xmp", "datalist"}
_UNWANTED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor(?:ed)?|promo\w*|outbrain|taboola|comments?|commentlist|disqus\w*|replies|sidebar|aside|widget|related|recommended|recirc|share|sharing|social|newsletter|subscribe|signup|login|cookies?|consent|gdpr|notices?|popup|modal|overlay|paywall|breadcrumbs?|crumbs?|menu|nav|navbar|navigation|toolbar|pagination|pager|masthead|footer)(?=$|[\s_-])", re.I)
#: Names that say so unless a wanted one stands beside them.
_DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:banner|respond|reply|responses|discussion|side|more|follow|alert|foot|copyright|legal|disclaimer|skip|search|tags|print)(?=$|[\s_-])", re.I)
_WANTED = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|hentry)(?=$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_SPACE = re.compile(r"\s+")
#: Opening one of these closes an open one of the set first, up to the given boundary.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("attrs", "children", "links", "parent", "score", "size", "tag")

    def __init__(self, tag: str, attrs: str, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []  # nodes and strings
        self.score = 0.0
        self.size = self.links = 0


def parse(page: str) -> Node:
    root = Node("#root", "", None)
    at, place = root, 0
    open_: dict[str, int] = {}  # how many elements of a tag are open: an end tag of none is passed over at once

    def leave(node: Node) -> None:
        """Close an open element and all within it."""
        nonlocal at
        while True:
            open_[at.tag] -= 1
            last, at = at, at.parent
            if last is node:
                return

    def close(tags: set, until: set) -> None:
        if not any(open_.get(t) for t in tags):
            return
        node = at
        while node is not root and node.tag not in until:
            if node.tag in tags:
                leave(node)
                return
            node = node.parent

    search = _TAG.search
    while True:
        m = search(page, place)
        if m is None:
            if place < len(page):
                at.children.append(page[place:])
            return root
        if m.start() > place:
            at.children.append(page[place : m.start()])
        place = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                leave(node)
            continue
        if tag in _BLOCK:
            close({"p"}, {"table", "button", "td", "th", "li", "div", "article", "section", "blockquote", "body"})
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        node = Node(tag, m[3], at)
        at.children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, place)
            stop = end.start() if end else len(page)
            node.children.append(page[place:stop])
            place = end.end() if end else len(page)
        elif tag not in _VOID:
            at = node
            open_[tag] = open_.get(tag, 0) + 1


def _attributes(node: Node) -> dict[str, str]:
    """The attributes of an element; of one that is repeated the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(node.attrs):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def _boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in _DROP or node.tag in ("header", "footer") and not (in_article and node.tag == "header"):
        return True
    if not node.attrs:
        return False
    a = _attributes(node)
    if a.get("role", "").lower() in _ROLES or "hidden" in a or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    if node.tag in ("body", "html", "article", "main"):
        return False
    named = f"{a.get('class', '')} {a.get('id', '')}"
    return bool(_UNWANTED.search(named)) or bool(_DOUBTFUL.search(named)) and not _WANTED.search(named)


def _wrappers(root: Node) -> set[int]:
    """Elements that hold an article and most of the page's text: their names say nothing about it."""
    size: dict[int, int] = {}
    holds: set[int] = set()
    for node in _post_order(root):
        here = 0
        if node.tag not in _DROP:
            for child in node.children:
                here += len(child) if isinstance(child, str) else size[id(child)]
        size[id(node)] = here
        if node.parent is not None and (node.tag in ("article", "main") or id(node) in holds):
            holds.add(id(node.parent))
    return {n for n in holds if 2 * size[n] >= size[id(root)]}


def _prune(root: Node) -> None:
    wrappers = _wrappers(root)
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        kept = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
            elif not _boilerplate(child, inside) or id(child) in wrappers and child.tag in ("div", "section"):
                kept.append(child)
                stack.append((child, inside or child.tag in ("article", "main")))
        node.children = kept


def _post_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    return out[::-1]


def _measure(root: Node) -> list[Node]:
    """Text and link lengths of every node, and the paragraphs' points passed to their ancestors."""
    order = _post_order(root)
    for node in order:
        own = commas = 0
        for child in node.children:
            if isinstance(child, str):
                n = len(child) if not child.isspace() else 0
                own += n
                commas += child.count(",") + child.count("、") + child.count("，")
            else:
                node.size += child.size
                node.links += child.links
        node.size += own
        if node.tag == "a":
            node.links = node.size
        if own and node.tag != "a":
            # a run of text is a paragraph; its nearest block is where its points start
            up = node
            while up.parent is not None and up.tag not in _BLOCK:
                up = up.parent
            points, share = 1 + commas + min(own / 100, 3), 1.0
            up = up if up.tag in ("div", "td", "section", "article", "body", "main", "#root") else up.parent or up
            while up is not None and share > 0.01:
                up.score += points * share
                share /= 2
                up = up.parent
    return order


def _weight(node: Node) -> float:
    density = node.links / node.size if node.size else 0.0
    bonus = 1.25 if node.tag in ("article", "main") else 1.0
    if node.attrs and node.tag not in ("body", "html"):
        a = _attributes(node)
        if _WANTED.search(f"{a.get('class', '')} {a.get('id', '')}"):
            bonus *= 1.25
    return node.score * (1 - density) * bonus


def _blocks(node: Node, out: list[str]) -> None:
    """The text of the blocks under a node, white space in one space."""
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            buffer.append(x)
        else:
            if x.tag == "br":
                buffer.append(" ")
            if x.tag in _BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    order = _measure(root)
    if not root.size:
        return ""
    best = max((n for n in order if n.tag in _BLOCK or n is root), key=_weight)
    # what stands beside the only article belongs to the page, not to the article; but an article never ends inside
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best = up
    keep = [best]
    if best.parent is not None:
        limit = max(10.0, 0.2 * _weight(best))
        keep = []
        for child in best.parent.children:
            if child is best:
                keep.append(child)
            elif not isinstance(child, str) and best.tag not in ("article", "main", "body", "html"):
                density = child.links / child.size if child.size else 1.0
                if _weight(child) >= limit or child.tag in ("p", "h1", "h2", "h3", "pre", "blockquote", "ul", "ol", "table") and density < 0.25:
                    keep.append(child)
            elif not isinstance(child, str) and child.tag == best.tag and _weight(child) >= limit:
                keep.append(child)
            elif isinstance(child, str) and not child.isspace() and best.tag not in ("article", "main"):
                keep.append(child)
    out: list[str] = []
    for node in keep:
        if isinstance(node, str):
            text = _SPACE.sub(" ", html.unescape(node)).strip()
            out.extend([text] if text else [])
        else:
            _blocks(node, out)
    return "\n".join(out)


def _extract(batches):
    takes_over("html_extract")
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, 256) for c in range(batch.num_columns - 1)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", page_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    small_batches(df.sparkSession)
    rows = df.select(id_col, url_col, df[page_col].cast("string").alias("_page"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    return rows.mapInArrow(_extract, f"{kinds}, text string, n_chars long")
