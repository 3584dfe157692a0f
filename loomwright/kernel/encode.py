"""The renderings of a document: minified, tabular, grid and dictionary bodies (see README for the grammar)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

from .parse import Document, Node
from .price import protected as _protected

#: Lexemes up to this length recur from document to document; what is found out about them is kept, for a bounded number of them.
KEPT_LENGTH, KEPT = 64, 1 << 14
#: Keys of up to this many levels below the first become dotted paths.
FLATTEN = 3
# Ids, first-line tags and fixed lines of the format.
IDS = {"passthrough": 0, "min": 1, "tbl": 2, "refs": 3, "jsonl": 4, "grid": 5}
FRAME = "#tkfd1 "
LEGEND = '#refs "$N" = entry N (from 0) of:\n'


def framed(tag: str, body: str) -> str:
    return f"{FRAME}{tag}\n{body}"


_known = lru_cache(KEPT)(lambda lexeme: _protected(lexeme) is not None)


def protected(lexeme: str) -> bool:
    return _known(lexeme) if len(lexeme) <= KEPT_LENGTH else _protected(lexeme) is not None


# --- minified ---

_ESCAPE = re.compile(r"\\(?:u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.S)
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 0x22: '\\"', 0x5C: "\\\\"}


def _spell(m: re.Match) -> str:
    if m[4]:
        return "/" if m[4] == "/" else m[0]
    code = int(m[3], 16) if m[3] else 0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00
    if code in _SHORT:
        return _SHORT[code]
    return f"\\u{code:04x}" if code < 0x20 else chr(code)


def canonical(lexeme: str) -> str:
    """The shortest spelling of a string; protected ones and those with a lone surrogate stay as they are."""
    if "\\" not in lexeme:
        return lexeme
    return _known_spelling(lexeme) if len(lexeme) <= KEPT_LENGTH else _spelling(lexeme)


def _spelling(lexeme: str) -> str:
    if protected(lexeme):
        return lexeme
    if any(m[3] and 0xD800 <= int(m[3], 16) <= 0xDFFF for m in _ESCAPE.finditer(lexeme)):
        return lexeme
    return _ESCAPE.sub(_spell, lexeme)


_known_spelling = lru_cache(KEPT)(_spelling)


_STRINGS = re.compile(r'("[^"\\]*+(?:\\.[^"\\]*+)*+")', re.S)


def minify(doc: Document) -> str:
    parts = _STRINGS.split(doc.text)  # strings stand at odd places
    # what stands between them has no quotes, so one joins it for the removal of white space
    parts[::2] = "".join('"'.join(parts[::2]).split()).split('"')
    if "\\" in doc.text:
        parts[1::2] = [canonical(x) if "\\" in x else x for x in parts[1::2]]
    return "".join(parts)


# --- blocks in place of arrays ---


def _arrays(root: Node, block: Callable[[Node], str | None]) -> list[tuple[Node, str]]:
    """Outermost arrays for which there is a block, in source order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.kind == "a" and (made := block(node)) is not None:
            out.append((node, made))
        elif node.kind in "oa":
            stack.extend(x[1] if node.kind == "o" else x for x in reversed(node.items))
    return out


def _replaced(tokens: list[str], blocks: list[tuple[Node, str]]) -> str | None:
    if not blocks:
        return None
    out, at = [], 0
    for node, block in blocks:
        out += tokens[at : node.first]
        out.append(block)
        at = node.last
    return "".join(out + tokens[at:])


def _all_objects(node: Node) -> bool:
    return len(node.items) >= 2 and all(x.kind == "o" for x in node.items)


def tabular(doc: Document) -> str | None:
    """Arrays of objects as tables of their commonest key list; None if there are none."""
    tokens = doc.tokens

    def block(node: Node) -> str | None:
        if not _all_objects(node):
            return None
        shapes = [tuple(tokens[k] for k, _ in x.items) for x in node.items]
        header, n = Counter(shapes).most_common(1)[0]  # of equal ones the first seen
        if n < 2 or not header:
            return None
        out = [f"\n#{len(node.items)}[{','.join(header)}]\n"]
        for shape, x in zip(shapes, node.items, strict=True):
            if shape == header:
                out.append(f"+[{','.join(doc.compact(v) for _, v in x.items)}]\n")
            else:
                out.append(f"*{doc.compact(x)}\n")
        return "".join(out)

    return _replaced(tokens, _arrays(doc.root, block))


# --- grid ---


@dataclass
class _Level:
    """The ordered union of the keys of some objects: key -> (rank, leaf number or the level below)."""

    rank: dict[str, int] = field(default_factory=dict)
    below: dict[str, _Level | int] = field(default_factory=dict)


def ordered_union(key_lists) -> list[str]:
    """Keys in order: a known key moves the cursor to itself, a new one goes right behind the cursor."""
    after: dict[str | None, str | None] = {None: None}
    for keys in key_lists:
        cursor = None
        for k in keys:
            if k not in after:
                after[k], after[cursor] = after[cursor], k
            cursor = k
    out, k = [], after[None]
    while k is not None:
        out.append(k)
        k = after[k]
    return out


_BARE = re.compile(r'"([A-Za-z_][A-Za-z0-9_-]*)"')


def segment(key: str) -> str:
    m = _BARE.fullmatch(key)
    return m[1] if m else key


class _Grid:
    def __init__(self, tokens: list[str], objects: list[Node]):
        self.tokens = tokens
        self.paths: list[str] = []
        self.root = self._level(objects, 0, "")

    def _level(self, objects: list[Node], depth: int, prefix: str) -> _Level:
        values: dict[str, list[Node]] = {}
        for x in objects:
            for k, v in x.items:
                values.setdefault(self.tokens[k], []).append(v)
        level = _Level()
        for rank, key in enumerate(ordered_union([self.tokens[k] for k, _ in x.items] for x in objects)):
            path = prefix + segment(key)
            level.rank[key] = rank
            if depth < FLATTEN and all(v.kind == "o" and v.items for v in values[key]):
                level.below[key] = self._level(values[key], depth + 1, path + ".")
            else:
                level.below[key] = len(self.paths)
                self.paths.append(path)
        return level

    def cells(self, node: Node) -> dict[int, Node] | None:
        """Leaf number -> value of a plain row; None for a row whose keys are not in strictly rising order."""
        out: dict[int, Node] = {}
        stack = [(node, self.root)]
        while stack:
            x, level = stack.pop()
            last = -1
            for k, v in x.items:
                key = self.tokens[k]
                if level.rank[key] <= last:
                    return None
                last = level.rank[key]
                below = level.below[key]
                if isinstance(below, int):
                    out[below] = v
                else:
                    stack.append((v, below))
        return out


def grid(doc: Document, tokens: list[str] | None = None) -> str | None:
    """Arrays of objects as grids over the union of their keys; None if there are none.

    ``tokens`` may hold other spellings of the document's tokens (see refs)."""
    tokens = doc.tokens if tokens is None else tokens
    grown: list[int] = []

    def size(node: Node) -> int:
        raw = len(doc.text[doc.starts[node.first] : doc.starts[node.last - 1] + 1].encode())
        if tokens is doc.tokens:
            return raw
        if not grown:
            grown.extend([0, *accumulate(len(b.encode()) - len(a.encode()) for a, b in zip(doc.tokens, tokens, strict=True))])
        return raw + grown[node.last] - grown[node.first]

    def block(node: Node) -> str | None:
        if not _all_objects(node):
            return None
        plan = _Grid(tokens, node.items)
        rows = [plan.cells(x) for x in node.items]
        plain = [r for r in rows if r is not None]
        cells = len(plain) * len(plan.paths)
        # a token is a byte or more, which mostly settles it
        if not plan.paths or len(plain) < 2 or cells > node.last - node.first and cells > size(node):
            return None
        text = lambda v: "".join(tokens[v.first : v.last])
        written = [None if r is None else {leaf: text(v) for leaf, v in r.items()} for r in rows]
        values: dict[int, set[str]] = {}
        count = Counter()
        for r in written:
            if r is not None:
                count.update(r.keys())
                for leaf, cell in r.items():
                    values.setdefault(leaf, set()).add(cell)
        head, varies = [], []
        for leaf, path in enumerate(plan.paths):
            if not count[leaf]:
                head.append(path + "=~")
            elif count[leaf] == len(plain) and len(values[leaf]) == 1:
                head.append(f"{path}={next(iter(values[leaf]))}")
            else:
                head.append(path)
                varies.append(leaf)
        out = [f"\n#{len(rows)}[{','.join(head)}]\n"]
        for r, x in zip(written, node.items, strict=True):
            out.append(f"*{text(x)}\n" if r is None else f"+{','.join(r.get(leaf, '~') for leaf in varies)}\n")
        return "".join(out)

    return _replaced(tokens, _arrays(doc.root, block))


# --- value dictionary ---

_SHAPED = re.compile(r'"\$+[0-9]+"')
_REFERENCE = re.compile(r'"\$(0|[1-9][0-9]*)"')
_STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)


def refs(doc: Document, estimate: Callable[[str], int]) -> str | None:
    """A legend of string values that repeat, and the grid with references to them; None if none pays."""
    sites: list[int] = []
    stack = [doc.root]
    while stack:
        node = stack.pop()
        if node.kind == "s":
            sites.append(node.first)
        elif node.kind in "oa":
            stack.extend(x[1] if node.kind == "o" else x for x in reversed(node.items))
    folded = {t: not protected(t) for t in {doc.tokens[i] for i in sites}}
    count = Counter(doc.tokens[i] for i in sites if folded[doc.tokens[i]])
    cost = {t: estimate(t) for t, n in count.items() if n >= 2}

    def pays(n: int, t: str, place: int) -> bool:
        return n * (cost[t] - estimate(f'"${place}"')) > cost[t] + 1

    kept: list[str] = []
    for t in sorted(cost, key=lambda t: (-count[t], -cost[t])):  # equal ones as first seen
        if pays(count[t], t, len(kept)):
            kept.append(t)

    def body(legend: list[str]) -> str | None:
        place = {t: f'"${i}"' for i, t in enumerate(legend)}
        tokens = list(doc.tokens)
        for i in sites:
            t = tokens[i]
            tokens[i] = place.get(t) or ('"$' + t[1:] if _SHAPED.fullmatch(t) else t)
        return grid(doc, tokens)

    if not kept or (first := body(kept)) is None:
        return None
    used = Counter(int(m[1]) for s in _STRING.findall(first) if (m := _REFERENCE.fullmatch(s)) and len(m[1]) < 12)
    places = [i for i, t in enumerate(kept) if pays(used[i], t, i)]
    final = [kept[i] for i in sorted(places, key=lambda i: -used[i])]
    if not final:
        return None
    last = first if final == kept else body(final)
    return None if last is None else f"{LEGEND}$=[{','.join(final)}]\n{last}"


# --- profiles ---

PROFILES = {"conservative": ("min",), "balanced": ("min", "tbl", "grid"), "aggressive": ("min", "tbl", "refs", "grid")}
RECORD_PROFILES = {"conservative": (), "balanced": ("jsonl",), "aggressive": ("jsonl",)}


def candidates(doc: Document, records: bool, profile: str, estimate: Callable[[str], int], only: int | None = None) -> list[tuple[int, str]]:
    """(encoder id, framed rendering) of every encoder of the profile that applies, or of one of them ``only``."""
    out = []
    for tag in (RECORD_PROFILES if records else PROFILES)[profile]:
        if only is not None and IDS[tag] != only:
            continue
        if tag == "min":
            body = minify(doc)
        elif tag in ("tbl", "jsonl"):
            body = tabular(doc)
        elif tag == "grid":
            body = grid(doc)
        else:
            body = refs(doc, estimate)
        if body is not None:
            out.append((IDS[tag], framed(tag, body)))
    return out
