"""The strict JSON of protocol messages and transcripts, as Python values."""

from __future__ import annotations

import json
import math
import re

from .parse import Document, Node, Rejected, parse

MAX_DEPTH = 128
MAX_VALUES = 4_194_304
_SURROGATE = re.compile("[\ud800-\udfff]")


def _bad(doc: Document, token: int, message: str) -> Rejected:
    return Rejected("invalid_json", message, byte_offset=len(doc.text[: doc.starts[token]].encode()))


def _string(doc: Document, token: int) -> str:
    text = json.loads(doc.tokens[token])
    if _SURROGATE.search(text):
        raise _bad(doc, token, "a surrogate stands alone")
    return text


def _scalar(doc: Document, node: Node):
    if node.kind == "s":
        return _string(doc, node.first)
    if node.kind == "n":
        lexeme = doc.tokens[node.first]
        if not set(".eE") & set(lexeme) and -(2**63) <= int(lexeme) < 2**63:
            return int(lexeme)
        value = float(lexeme)
        if not math.isfinite(value):
            raise _bad(doc, node.first, "the number is out of range")
        return value
    return {"t": True, "f": False, "z": None}[node.kind]


def loads(text: str, max_depth: int = MAX_DEPTH, max_values: int = MAX_VALUES):
    """The value of a message; repeated keys, lone surrogates, infinite numbers and oversized trees are refused."""
    doc = parse(text, max_depth)
    result: list = []
    stack = [(doc.root, result.append)]
    count = 0
    while stack:
        node, put = stack.pop()
        count += 1
        if count > max_values:
            raise _bad(doc, node.first, "too many values")
        if node.kind == "a":
            out = [None] * len(node.items)
            put(out)
            stack.extend((x, lambda v, out=out, i=i: out.__setitem__(i, v)) for i, x in reversed(list(enumerate(node.items))))
        elif node.kind == "o":
            made: dict = {}
            put(made)
            pairs = []
            for k, x in node.items:
                name = _string(doc, k)
                if name in made:
                    raise _bad(doc, k, "a key is repeated")
                made[name] = None
                pairs.append((x, lambda v, made=made, name=name: made.__setitem__(name, v)))
            stack.extend(reversed(pairs))
        else:
            put(_scalar(doc, node))
    return result[0]


def dumps(value) -> str:
    """Compact text; whole floats keep their point."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def truthy(value) -> bool:
    return bool(value)


def count_field(record, key: str) -> int:
    """A non-negative whole number, else 0."""
    value = record.get(key) if isinstance(record, dict) else None
    return value if type(value) is int and value > 0 else 0


def text_field(record, key: str) -> str | None:
    value = record.get(key) if isinstance(record, dict) else None
    return value if isinstance(value, str) else None
