"""A strict JSON reader that keeps every lexeme: numbers, escapes, key order and repeated keys stay as written."""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np

MAX_DEPTH = 512
MAX_BYTES = 16 * 1024 * 1024

_TOKEN = re.compile(
    r"""[ \t\n\r]*+(?:([{}\[\],:])|("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)|(true|false|null))"""
)
_SPACE = re.compile(r"[ \t\n\r]*+")
_NUMBER = re.compile(r"-?(0(?=[0-9]))?(?:[0-9]++(?:(\.)(?![0-9])|(?:\.[0-9]++)?+(?:([eE][+-]?+)(?![0-9]))?)?)?")
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
_PLAIN = re.compile(r'[^"\\\x00-\x1f]*+')


class Rejected(Exception):
    """Why a document is refused: a code with the numbers that belong to it."""

    def __init__(self, code: str, message: str, byte_offset: int | None = None, size: int | None = None, depth: int | None = None, limit: int | None = None):
        super().__init__(message)
        self.code, self.message, self.byte_offset, self.size, self.depth, self.limit = code, message, byte_offset, size, depth, limit


class Node:
    """A value: kind is o, a, s, n, t, f or z (null); tokens [first, last) are its text without white space."""

    __slots__ = ("kind", "first", "last", "depth", "items")

    def __init__(self, kind: str, first: int, last: int, depth: int, items: list | tuple = ()):
        self.kind, self.first, self.last, self.depth = kind, first, last, depth
        #: values of an array, (key token, value) of an object
        self.items = items


class Document:
    """A text that parse() took, whose tokens, their places and the tree are found when they are asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def tokens(self) -> list[str]:
        return _VALID.findall(self.text)

    @cached_property
    def starts(self) -> list[int]:
        out, at, find = [], 0, self.text.index
        for token in self.tokens:  # between tokens is white space alone
            at = find(token, at)
            out.append(at)
            at += len(token)
        return out

    @cached_property
    def root(self) -> Node:
        return _tree(self.tokens)

    def compact(self, node: Node) -> str:
        return "".join(self.tokens[node.first : node.last])


def byte_lengths(text: str) -> np.ndarray | None:
    """UTF-8 offsets of each character and the end; None for ASCII, where they are the indices."""
    if text.isascii():
        return None
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])


def byte_offset(text: str, at: int) -> int:
    return len(text[:at].encode())


def _bad(text: str, at: int, message: str) -> Rejected:
    return Rejected("invalid_json", message, byte_offset=byte_offset(text, at))


def _string_fault(text: str, at: int) -> Rejected:
    """What is wrong with a string that opens at ``at``."""
    at += 1
    while True:
        at = _PLAIN.match(text, at).end()
        if at >= len(text):
            return _bad(text, at, "the string does not end")
        if text[at] != "\\":
            return _bad(text, at, "a control character stands in a string")
        if m := _ESCAPE.match(text, at):
            at = m.end()
        elif at + 1 >= len(text):
            return _bad(text, at + 1, "the string ends in an escape")
        elif text[at + 1] != "u":
            return _bad(text, at + 1, "no such escape")
        else:
            digits = re.compile("[0-9a-fA-F]{0,4}").match(text, at + 2).end()
            return _bad(text, digits, "a unicode escape takes four hex digits")


def _value_fault(text: str, at: int) -> Rejected:
    """What is wrong where a value should stand."""
    if at >= len(text):
        return _bad(text, at, "the document ends where a value should stand")
    c = text[at]
    if c == '"':
        return _string_fault(text, at)
    if c == "-" or "0" <= c <= "9":
        return _number_fault(text, at) or _bad(text, at, "no number")
    for word in ("true", "false", "null"):
        if c == word[0]:
            same = next((i for i, (x, y) in enumerate(zip(word, text[at : at + 5], strict=False)) if x != y), min(len(word), len(text) - at))
            if same >= 2 or at + same >= len(text):
                return _bad(text, at, f"{word} was begun")
    return _bad(text, at, "a value should stand here")


def _number_fault(text: str, at: int) -> Rejected | None:
    m = _NUMBER.match(text, at)
    if m[1]:
        return _bad(text, m.start(1), "a number has no leading zeros")
    if m[2]:
        return _bad(text, m.end(2), "a digit should follow the point")
    if m[3]:
        return _bad(text, m.end(3), "a digit should follow the exponent")
    if m[0] in ("", "-"):
        return _bad(text, m.end(), "a digit should stand here")
    return None


def _constant(word: str) -> None:
    raise ValueError(word)  # NaN and Infinity are no JSON


#: The library's reader, in C. It takes less than parse() does (not numbers of very many digits), and never more but for depth.
_READER = json.JSONDecoder(parse_constant=_constant)
#: The tokens of a text that is known to be a document.
_VALID = re.compile(r'[{}\[\],:]|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^ \t\n\r{}\[\],:"]++')
_DEEPER = {"{": 1, "[": 1, "}": -1, "]": -1}
_OPENING = re.compile(r"\[(?:[ \t\n\r]*+\[)++")


@lru_cache(maxsize=16)
def _too_deep(max_depth: int) -> re.Pattern:
    """A text whose first tokens open more containers than may be, whatever follows."""
    one = r"[ \t\n\r]*+(?:\[|\{[ \t\n\r]*+" + r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"' + r"[ \t\n\r]*+:)"
    return re.compile("(?:" + one + "){" + str(max_depth) + r"}[ \t\n\r]*+[\[{]")


def _accepted(text: str) -> bool:
    try:
        if text[:1] in ("{", "["):  # as decode() does, without its two searches for white space
            end = _READER.scan_once(text, 0)[1]
            return end == len(text) or not text[end:].strip(" \t\n\r")
        _READER.decode(text)
    except (ValueError, RecursionError, StopIteration):  # parse() says what is wrong, if anything is
        return False
    return True


def _deep(depth: int, limit: int) -> Rejected:
    return Rejected("depth_exceeded", "the document is nested too deep", depth=depth, limit=limit)


def parse(text: str, max_depth: int = MAX_DEPTH) -> Document:
    """Read one document; raises Rejected with invalid_json or depth_exceeded."""
    openers = text.count("{") + text.count("[")
    if openers > max_depth and _too_deep(max_depth).match(text):
        raise _deep(max_depth + 1, max_depth)
    if not _accepted(text):
        _walk(text, max_depth)
    doc = Document(text)
    if openers > max_depth and max(accumulate(_DEEPER.get(t, 0) for t in doc.tokens)) > max_depth:
        raise _deep(max_depth + 1, max_depth)
    return doc


def _walk(text: str, max_depth: int) -> None:
    """Go through a document token by token to its fault, if it has one."""
    open_: list[str] = []
    # what may come: v value, V value or ], k key, K key or }, c colon, n what follows a value, e end
    state, at, match = "v", 0, _TOKEN.match
    while state != "e":
        m = match(text, at)
        if m is None:
            at = _SPACE.match(text, at).end()
            if state in "vV":
                raise _value_fault(text, at)
            if state in "kK" and text[at : at + 1] == '"':
                raise _string_fault(text, at)
            raise _bad(text, at, "the document ends early" if at >= len(text) else "this cannot stand here")
        group = m.lastindex
        start, at = m.start(group), m.end()
        if group == 1:
            token = m[1]
            if token in "{[" and state in "vV":
                more = 1
                if token == "[" and (run := _OPENING.match(text, start)):
                    more, at = run[0].count("["), run.end()
                if len(open_) + more > max_depth:
                    raise _deep(max_depth + 1, max_depth)
                open_ += token * more
                state = "K" if token == "{" else "V"
            elif (token == "}" and (state == "K" or state == "n" and open_[-1] == "{")) or (token == "]" and (state == "V" or state == "n" and open_[-1] == "[")):
                open_.pop()
                state = "n" if open_ else "e"
            elif token == "," and state == "n":
                state = "k" if open_[-1] == "{" else "v"
            elif token == ":" and state == "c":
                state = "v"
            else:
                raise _bad(text, start, "a value should stand here" if state in "vV" else "this cannot stand here")
        elif state in "kK" and group == 2:
            state = "c"
        elif state in "vV":
            if group == 3 and (fault := _number_fault(text, start)):
                raise fault
            state = "n" if open_ else "e"
        else:
            raise _bad(text, start, "this cannot stand here")
    at = _SPACE.match(text, at).end()
    if at < len(text):
        raise _bad(text, at, "something follows the document")


def _tree(tokens: list[str]) -> Node:
    """The root of a document of these tokens."""
    top = Node("a", 0, 0, 0, [])  # stands for the place of the root
    open_ = [top]
    node, key = top, -1
    for i, token in enumerate(tokens):
        c = token[0]
        if c in ",:":
            continue
        if c in "}]":
            open_.pop().last = i + 1
            node, key = open_[-1], -1
            continue
        if c == '"':
            if key < 0 and node.kind == "o":
                key = i
                continue
            made = Node("s", i, i + 1, len(open_) - 1)
        elif c in "{[":
            made = Node("o" if c == "{" else "a", i, 0, len(open_) - 1, [])
        else:
            made = Node(c if c in "tf" else "z" if c == "n" else "n", i, i + 1, len(open_) - 1)
        if key >= 0:
            node.items.append((key, made))
            key = -1
        else:
            node.items.append(made)
        if c in "{[":
            open_.append(made)
            node = made
    return top.items[0]


def decode(content: bytes, max_bytes: int = MAX_BYTES) -> str:
    """The text of a document that is neither too large nor ill-encoded."""
    if len(content) > max_bytes:
        raise Rejected("input_too_large", "the document is too large", size=len(content), limit=max_bytes)
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Rejected("not_utf8", "the document is not UTF-8", byte_offset=e.start) from None


def records(text: str, max_depth: int = MAX_DEPTH) -> list[str] | None:
    """The records of JSON Lines: at least two lines that are not blank, each a document; else None."""
    if "\n" not in text:
        return None
    lines = [line for line in text.split("\n") if line.strip(" \t\r")]
    if len(lines) < 2:
        return None
    try:
        for line in lines:
            parse(line, max_depth)
    except Rejected:
        return None
    return lines


def read(text: str, max_depth: int = MAX_DEPTH) -> tuple[Document, bool]:
    """The document, or the array of its records if it is JSON Lines (then True)."""
    try:
        return parse(text, max_depth), False
    except Rejected as fault:
        lines = records(text, max_depth) if fault.code == "invalid_json" else None
        if lines is None:
            raise
        return parse(f"[{','.join(lines)}]", max_depth + 1), True


_KINDS = {"s": "String", "n": "Number", "t": "Bool", "f": "Bool", "z": "Null"}


def nodes(doc: Document) -> list[tuple]:
    """The node relation in source order: (idx, kind, start, end, depth, n, b), byte offsets half open."""
    at = byte_lengths(doc.text)
    place = (lambda i: i) if at is None else (lambda i: int(at[i]))
    out: list[tuple] = []

    def add(kind: str, token: int, depth: int, n: int | None = None, b: bool | None = None) -> None:
        start = doc.starts[token]
        out.append((len(out), kind, place(start), place(start + len(doc.tokens[token])), depth, n, b))

    stack: list = [doc.root]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            if x[0] == "end":
                add("ObjectEnd" if x[1].kind == "o" else "ArrayEnd", x[1].last - 1, x[1].depth)
            else:
                add("Key", x[1], x[2])
        elif x.kind in "oa":
            add("ObjectStart" if x.kind == "o" else "ArrayStart", x.first, x.depth, len(x.items))
            stack.append(("end", x))
            for item in reversed(x.items):
                if x.kind == "o":
                    stack += [item[1], ("key", item[0], x.depth + 1)]
                else:
                    stack.append(item)
        else:
            add(_KINDS[x.kind], x.first, x.depth, None, x.kind == "t" if x.kind in "tf" else None)
    return out
