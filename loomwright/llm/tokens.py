"""Token ids of whole texts by the tokenizers library, on one core.

A byte-level vocabulary cuts a text by a fixed pattern (a contraction, or letters, digits or marks with at
most one space before them, or white space) before it merges bytes. Some places are cuts of that pattern
whatever stands around them, and are found over the UTF-8 bytes of many texts at once:
  - before a space that a character other than white space follows,
  - where a run of letters or of digits ends at a mark or at the other of the two, and where a mark other
    than the apostrophe ends at a letter or digit,
  - around a line feed that stands alone between characters that are no white space.
So the ids of a text are those of the pieces between such places in turn. Pieces of up to ``KEY`` bytes are
looked up in a table of a fixed number of slots, all at once, in NumPy; the others are made distinct by
Arrow and encoded by the library: those that the pattern matches whole many in one call without it, the
rest one by one. A full table keeps what came first. A text that contains an added token (which gets its own
id) is encoded whole, as is every text under a vocabulary of another kind.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import HELD

KEY = 24
#: The table has 2 ** SLOTS slots of 31 bytes, of which FULL are filled at most.
SLOTS, FULL = 19, 320_000
#: Bytes of text that are looked at together; a longer text is taken in such parts.
SPAN = 1 << 19

_CODES = np.arange(256)
_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
_DIGIT = (_CODES >= 48) & (_CODES < 58)
_MARK = (_CODES > 32) & (_CODES < 127) & ~_LETTER & ~_DIGIT
#: First bytes of characters of two bytes that are letters, but for the two signs C3 97 and C3 B7.
_LEAD = np.isin(_CODES, [*range(0xC3, 0xC9), 0xD0, 0xD1])
_NEXT = (_CODES >= 0x80) & (_CODES < 0xC0)
#: First bytes of characters that are no white space for certain (some behind C2, E1, E2 and E3 are).
_INK = _LETTER | _DIGIT | _MARK | (_CODES >= 0xC3) & ~np.isin(_CODES, (0xE1, 0xE2, 0xE3))
#: What a piece is made of: 1 letters, 2 digits, 4 marks but the apostrophe, 8 anything else.
_CLASS = np.where(_LETTER | _LEAD | _NEXT, 1, np.where(_DIGIT, 2, np.where(_MARK & (_CODES != 39), 4, 8))).astype(np.uint8)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _written() -> np.ndarray:
    """The characters that byte-level vocabularies write for the 256 bytes: printable ones for themselves, others from 256 on."""
    own = (_CODES >= 33) & (_CODES <= 126) | (_CODES >= 161) & (_CODES != 173)
    return np.where(own, _CODES, 256 + np.cumsum(~own) - 1).astype("<u2")


_WRITTEN = _written()


def _letters(b: np.ndarray) -> np.ndarray:
    """Whether each byte ends a letter for certain."""
    out = _LETTER[b]
    sign = (b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7))
    out[1:] |= _LEAD[b[:-1]] & _NEXT[b[1:]] & ~sign
    return out


def cut_places(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places in the bytes of texts, one behind another, at which pieces begin; ``ends`` are the texts' ends, ascending."""
    cut = np.zeros(len(b), bool)
    letter, digit, mark = _letters(b), _DIGIT[b], _MARK[b]
    ink, shown = _INK[b], letter | digit | mark
    cut[:-1] = (b[:-1] == 32) & ink[1:]
    cut[1:] |= letter[:-1] & (mark | digit)[1:]
    cut[1:] |= digit[:-1] & (mark | _LETTER[b])[1:]
    cut[1:] |= (mark & (b != 39))[:-1] & (digit | _LETTER[b])[1:]
    alone = (b[1:-1] == 10) & shown[:-2] & ink[2:] if len(b) > 2 else np.zeros(0, bool)
    cut[1:-1] |= alone
    cut[2:] |= alone
    # a text's last byte has nothing behind it, and its first nothing before it
    cut[ends[:-1][ends[:-1] < len(b)]] = True
    if len(b):
        last = ends[ends > 0] - 1
        lone = (np.diff(ends, prepend=0)[ends > 0] == 1) | ~(b[last] == 32)
        cut[last[~lone]] = False
        cut[0] = True
    return np.flatnonzero(cut)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        split = self.tokenizer.pre_tokenizer
        spec = json.loads(split.__getstate__()) if split is not None else {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)).encode() if added else rb"(?!)")
        self.by_piece = spec.get("type") == "ByteLevel" and not spec.get("add_prefix_space") and spec.get("use_regex", True) and self.tokenizer.normalizer is None and self.tokenizer.post_processor is None
        if self.by_piece:
            self.words = Tokenizer(self.tokenizer.model)  # the same merges, for pieces that are cut already
            self.words.pre_tokenizer = CharDelimiterSplit("\n")
            if hasattr(self.words.model, "_resize_cache"):
                self.words.model._resize_cache(1)  # every word comes once: the library's own cache would only be filled
            token = self.tokenizer.id_to_token  # each character of a token stands for one byte
            self.width = np.fromiter((len(token(i) or "") for i in range(self.tokenizer.get_vocab_size())), np.int64)
            self.keys = np.zeros((KEY // 8, 1 << SLOTS), np.uint64)
            self.long = np.zeros(1 << SLOTS, np.uint8)  # bytes of a slot's piece; 0: a free slot
            self.at = np.zeros(1 << SLOTS, np.uint32)
            self.count = np.zeros(1 << SLOTS, np.uint16)
            self.held = self.used = 0
            self.ids = np.zeros(1 << 20, "<u4")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _first_slot(self, keys: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        h = n.astype(np.uint64) * _ODD[3]
        for k, odd in zip(keys, _ODD, strict=False):
            h = (h ^ k) * odd
            h ^= h >> np.uint64(29)
        return ((h * _ODD[0]) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _find(self, keys: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """The slots of pieces; -1 for one that is not in the table."""
        out = np.full(len(n), -1, np.int64)
        left, slot = np.arange(len(n)), self._first_slot(keys, n)
        while len(left):
            there = self.long[slot]
            same = there == n[left]
            for k, held in zip(keys, self.keys, strict=True):
                same &= held[slot] == k[left]
            out[left[same]] = slot[same]
            on = ~same & (there > 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << SLOTS) - 1)
        return out

    def _store(self, keys: list[np.ndarray], n: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """Put distinct pieces that are not in the table into free slots."""
        left, slot = np.arange(len(n)), self._first_slot(keys, n)
        owner = np.empty(1 << SLOTS, np.int32)
        while len(left):
            free = self.long[slot] == 0
            owner[slot[free]] = left[free]
            won = free.copy()
            won[free] = owner[slot[free]] == left[free]
            to, who = slot[won], left[won]
            for k, held in zip(keys, self.keys, strict=True):
                held[to] = k[who]
            self.long[to], self.at[to], self.count[to] = n[who], at[who], count[who]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << SLOTS) - 1)
        self.held += len(n)

    def _add(self, ids: np.ndarray) -> int:
        """Append ids to what is held; their place."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(self.used, len(self.ids)), "<u4")])
        self.ids[at : self.used] = ids
        return at

    def _learn(self, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode distinct pieces, given by their bytes: their places among the ids that are held, and their counts."""
        starts = np.concatenate([[0], ends[:-1]])
        n = ends - starts
        kind = _CLASS[b]
        kind[:-1] |= np.where((b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7)), 8, 0).astype(np.uint8)
        kind[starts[(b[starts] == 32) & (n > 1)]] = 0
        made = np.bitwise_or.reduceat(kind, starts)
        plain = (made == 1) | (made == 2) | (made == 4)
        at, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        some = np.flatnonzero(plain)
        if len(some):
            # a line feed, as which no byte is written, behind each
            room = n[some] + 1
            to = np.cumsum(room)
            chars = np.full(int(to[-1]), 10, "<u2")
            within = np.ones(len(chars), bool)
            within[to - 1] = False
            chars[within] = _WRITTEN[b[np.repeat(plain, n)]]
            ids = np.array(self.words.encode_batch_fast([chars.tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, "<u4")
            stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(n[some])) + 1
            count[some] = np.diff(stops, prepend=0)
            at[some] = self._add(ids) + stops - count[some]
        rest = np.flatnonzero(~plain)
        raw = b.tobytes()
        for i, ids in zip(rest.tolist(), self._encode([raw[x:y].decode() for x, y in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]), strict=True):
            at[i], count[i] = self._add(ids), len(ids)
        return at, count

    def _span(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one behind another, and the texts' ends among them."""
        b = np.frombuffer(data, np.uint8)
        places = cut_places(b, ends)
        n = np.diff(places, append=len(b))
        view = np.ndarray((len(b) + KEY - 7,), "<u8", data + bytes(KEY), strides=(1,))
        keys = [view[np.minimum(places + 8 * k, len(b))] & _MASK[np.clip(n - 8 * k, 0, 8)] for k in range(KEY // 8)]
        slot = self._find(keys, np.where(n <= KEY, n, 255).astype(np.uint8))
        at, count = self.at[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new, before = np.flatnonzero(slot < 0), self.used
        kept = before
        if len(new):
            offsets = np.append(places, len(b)).astype(np.int64)
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).take(pa.array(new)).dictionary_encode()
            which, distinct = pieces.indices.to_numpy(), pieces.dictionary
            edges = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1)
            found, much = self._learn(np.frombuffer(distinct.buffers()[2], np.uint8, int(edges[-1])), edges[1:])
            at[new], count[new] = found[which], much[which]
            first = np.zeros(len(distinct), np.int64)
            first[which[::-1]] = new[::-1]
            short = (n[first] <= KEY) & (much < 1 << 16)
            if self.held + int(short.sum()) <= FULL:
                some = first[short]
                self._store([k[some] for k in keys], n[some].astype(np.uint8), found[short], much[short])
                kept = self.used
        filled = np.cumsum(count)
        out = self.ids[np.repeat(at - filled + count, count) + np.arange(int(filled[-1]))] if len(filled) else np.zeros(0, "<u4")
        self.used = kept  # the ids of what found no room are forgotten
        return out, np.concatenate([[0], filled])[np.searchsorted(places, ends)]

    def _parts(self, raw: bytes) -> list[bytes]:
        """A text in parts of at most about SPAN bytes, between pieces."""
        parts, at = [], 0
        while len(raw) - at > SPAN:
            # a piece begins at the last space before a visible character
            m = None
            for m in re.finditer(rb"[!-~] (?=[!-~])", raw[at : at + SPAN]):
                pass
            stop = at + m.start() + 1 if m else None
            if stop is None:
                return [*parts, raw[at:]]
            parts.append(raw[at:stop])
            at = stop
        return [*parts, raw[at:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text (null: empty) its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        group: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal group, size
            if group:
                ids, ends = self._span(b"".join(r for _, r in group), np.cumsum([len(r) for _, r in group]))
                flat, at = memoryview(ids.tobytes()), 0
                for (i, _), stop in zip(group, (4 * ends).tolist(), strict=True):
                    out[i], at = out[i] + bytes(flat[at:stop]), stop
            group, size = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode()
            if not self.by_piece or self.added.search(raw):
                out[i] = self._encode([text])[0].tobytes()
                continue
            for part in self._parts(raw) if len(raw) > SPAN else (raw,):
                if size + len(part) > SPAN:
                    flush()
                group.append((i, part))
                size += len(part)
        flush()
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


HELD["tokens"] = encoder.cache_clear
