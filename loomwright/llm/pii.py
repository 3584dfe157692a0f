"""Personal data: fixed base patterns, and a span classifier trained by weak supervision.

Base spans come from four fixed patterns (email, ip, card, phone), leftmost and non-overlapping per kind;
a match that fails its check is dropped and not retried. So numbers that stand next to each other, or
written-out addresses, are lost to them. The method's population is wider: all base spans, and looser
proposals of each kind, those that fail a checksum, a range or a length among them. Labelers vote on each
(1 personal, -1 not, 0 abstains): strict form, checksum or structure, gazetteer (issuers, top-level
domains, reserved nets, country codes), words before the span, its borders, and overlap with longer
candidates of other kinds. Expectation-maximisation over the counts of all vote patterns estimates how
reliable each labeler is on each kind, for and against, and the posteriors of the patterns train a logistic
span classifier on kind, votes and their products. Base spans stay whatever the vote; other candidates with
a probability of at least ``threshold`` that no base span overlaps are added.

Only counts of vote patterns (at most 4 * 3^6) reach the driver, whatever the corpus.

Edge cases: a null text is empty; texts without spans give zeros, the hash of the empty string and an
empty list; of candidates that overlap, the more probable is kept, at a tie the earlier and longer one; rows
that repeat are read alike; other columns are ignored; without candidates there is no classifier and base
spans stand alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, takes_over

KINDS = ("email", "ip", "card", "phone")

# A digit run is entered at its start only: a match that fails there fails everywhere in the run.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    done = 0
    for m in _AT.finditer(text):
        at = m.start()
        first = at
        while first > done and (text[first - 1].isascii() and (text[first - 1].isalnum() or text[first - 1] in "._%+-")):
            first -= 1
        if first < at:
            done = m.end()
            yield first, m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text, by start, then kind."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            d = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return ordered(out)


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Proposals
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
#: What stands between the two halves of an address, written out or not; without brackets a written-out dot must follow.
_P_AT = re.compile(r"\s?(?:@|[\[({]\s?(?:at|AT)\s?[\])}])\s?|\s(?:at|AT)\s(?=[A-Za-z0-9-]{1,63}\s(?:dot|DOT)\s)")
_P_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\Z")
_P_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,4}}")
_P_PHONE = re.compile(r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])")
_P_CARD = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{4}(?P<s>[\x20-]?)[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{1,7}|[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9A-Za-z])")
_P_IP = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,4}(?:\.[0-9]{1,4}){3,5}(?![0-9A-Za-z])")

# Fixed gazetteers.
_TLDS = frozenset("com org net edu gov mil int info biz name pro mobi travel museum io co ai me tv cc dev app uk de fr es it nl eu us ca au nz ch at be se no dk fi ie is pl pt cz sk hu ro bg gr tr ua ru br mx ar cl pe uy in cn jp kr tw hk sg th vn id my ph il ae sa eg ma ng ke za example test".split())
_ISSUERS = re.compile(r"(?:4|5[0-8]|2[2-7]|3[47]|6(?:011|4|5|2)|35|30|36|38)")
_RESERVED = re.compile(r"(?:0|127|22[4-9]|2[3-5][0-9])\.|255\.255\.|[0-9]+\.[0-9]+\.[0-9]+\.0\Z")
#: Assigned country codes: of one digit, of two digits, and zones of three digits.
_COUNTRY = re.compile(r"\+(?:1|7|2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9])")
_WORDS = {
    "email": (re.compile(r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b", re.I), re.compile(r"\b(?:meet|arrive|look|stay)\b", re.I)),
    "ip": (re.compile(r"\b(?:ip|address|host|server|client|from|login|addr)\b", re.I), re.compile(r"\b(?:version|ver|section|release|v|chapter|figure)\b", re.I)),
    "card": (re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|cc|karte|tarjeta|carte|pan)\b", re.I), re.compile(r"\b(?:order|invoice|isbn|id|ref|serial|tracking|token|key|hash)\b", re.I)),
    "phone": (re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|telefon|tel[eé]fono|t[eé]l)\b", re.I), re.compile(r"\b(?:order|invoice|isbn|id|ref|serial|account|token|key|hash|card)\b", re.I)),
}
LABELERS = ("format", "structure", "gazetteer", "context", "border", "overlap")


def _proposals(text: str):
    done = 0
    for m in _P_AT.finditer(text) if "@" in text or _AT_WORD.search(text) else ():
        local = _P_LOCAL.search(text, max(done, m.start() - 64), m.start())
        host = _P_HOST.match(text, m.end())
        if local and host:
            done = host.end()
            yield "email", local.start(), done
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _P_IP), ("card", _P_CARD), ("phone", _P_PHONE)):
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()


_AT_WORD = re.compile(r"[\s\[({](?:at|AT)[\s\])}]")


def _votes(text: str, kind: str, a: int, b: int, others: list[tuple[str, int, int]]) -> tuple[int, ...]:
    span = text[a:b]
    digits = _NOT_DIGIT.sub("", span)
    if kind == "email":
        host = _P_AT.split(span, maxsplit=1)[-1]
        labels = re.split(_DOT, host)
        form = 1 if _PLAIN_EMAIL.fullmatch(span) or re.search(r"[\[({]", span) else 0 if "@" not in span else -1
        structure = 1 if len(labels) >= 2 and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 12 else -1
        gazetteer = 1 if len(labels) >= 2 and labels[-1].lower() in _TLDS else -1
    elif kind == "ip":
        parts = [int(p) for p in span.split(".")]
        form = 1 if len(parts) == 4 and all(p == str(int(p)) for p in span.split(".")) else -1
        structure = 1 if len(parts) == 4 and max(parts) <= 255 and len(set(parts)) > 1 else -1
        gazetteer = -1 if _RESERVED.match(span) else 1 if max(parts) > 20 else 0
    elif kind == "card":
        form = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}", span) else -1
        structure = 1 if luhn(digits) and len(set(digits)) > 1 else -1
        gazetteer = 1 if _ISSUERS.match(digits) and len(digits) in (14, 15, 16, 19) else -1
    else:
        form = 1 if re.search(r"[+(]", span) else -1 if span.isdigit() else 0
        structure = 1 if 10 <= len(digits) <= 15 else -1
        if span.startswith("+"):
            gazetteer = 1 if _COUNTRY.match(span) else -1
        else:
            gazetteer = 1 if re.fullmatch(r"\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9][0-9]{2}[\x20.-]?[0-9]{4}", span) else 0
    before = text[max(0, a - 40) : a]
    good, bad = _WORDS[kind]
    context = 1 if good.search(before) else -1 if bad.search(before) else 0
    left, right = text[max(0, a - 1) : a], text[b : b + 1]
    open_ = not left or left.isspace() or left in "\"'(<[:,;|="
    shut = not right or right.isspace() or right in "\"')>],;:!?|*" or right == "." and not text[b + 1 : b + 2].isalnum()
    border = 1 if open_ and shut else -1
    # of two candidates of one length, the kind that is listed first is the longer
    longer = (b - a, -KINDS.index(kind))
    overlap = -1 if any(k != kind and s < b and a < e and (e - s, -KINDS.index(k)) > longer for k, s, e in others) else 0
    return form, structure, gazetteer, context, border, overlap


_PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple[int, ...], bool]]:
    """Base spans, and the proposals that overlap none of their own kind: (kind, start, end, the labelers' votes, whether base)."""
    own = set(base)
    loose = [c for c in _proposals(text) if not any(k == c[0] and s < c[2] and c[1] < e for k, s, e in base)]
    every = [*base, *loose]
    return [(k, a, b, _votes(text, k, a, b, every), (k, a, b) in own) for k, a, b in every]


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    #: (kind, labeler) -> the shares of personal candidates that it votes for, and of others that it votes against
    reliability: dict[tuple[str, str], tuple[float, float]]
    #: kind -> expected number of personal candidates, and of others
    population: dict[str, tuple[float, float]]

    def probability(self, kind: str, votes: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-(_row(kind, votes) @ self.weights))))


def _row(kind: str, votes: tuple[int, ...]) -> np.ndarray:
    one = np.array([k == kind for k in KINDS], float)
    pos, neg = np.array([v > 0 for v in votes], float), np.array([v < 0 for v in votes], float)
    return np.concatenate([one, pos, neg, np.outer(one, pos).ravel(), np.outer(one, neg).ravel()])


#: Expected shares of the votes 1, 0 and -1 on personal spans and on others, before any candidate is seen.
_EXPECTED = np.array([[0.7, 0.2, 0.1], [0.25, 0.25, 0.5]])
#: Those of checks whose errors are known by their making: a number that is no card passes its checksum once in ten times.
_CHECKS = {"structure": np.array([[0.985, 0.01, 0.005], [0.1, 0.02, 0.88]]), "overlap": np.array([[0.01, 0.96, 0.03], [0.01, 0.5, 0.49]])}


def train(patterns: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> Classifier | None:
    """EM over vote patterns per kind, then the span classifier on the patterns' posteriors."""
    if not patterns:
        return None
    rows, target, weight, reliability, population = [], [], [], {}, {}
    for kind in KINDS:
        some = [(v, n) for (k, v), n in sorted(patterns.items()) if k == kind]
        if not some:
            continue
        votes, n = np.array([v for v, _ in some]), np.array([c for _, c in some], float)
        cast = np.stack([votes == v for v in (1, 0, -1)], axis=2).astype(float)  # pattern x labeler x vote
        # what is expected weighs as ten candidates; of a check with known errors, twenty times all of them
        expected = np.stack([_CHECKS.get(name, _EXPECTED) * (20 * n.sum() + 10 if name in _CHECKS else 10) for name in LABELERS])
        theta, prior = expected / expected.sum(axis=2, keepdims=True), 0.5
        for _ in range(rounds):
            score = np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", cast, np.log(theta[:, 0] / theta[:, 1]))
            p = 1 / (1 + np.exp(-score))
            prior = np.clip(((p * n).sum() + 1) / (n.sum() + 2), 0.02, 0.98)
            seen = np.stack([np.einsum("p,plv->lv", share * n, cast) for share in (p, 1 - p)], axis=1) + expected
            theta = seen / seen.sum(axis=2, keepdims=True)
        reliability |= {(kind, name): (float(theta[j, 0, 0]), float(theta[j, 1, 2])) for j, name in enumerate(LABELERS)}
        population[kind] = float((p * n).sum()), float(((1 - p) * n).sum())
        rows += [_row(kind, tuple(v)) for v in votes]
        target += p.tolist()
        weight += (np.log1p(n)).tolist()
    x, y, w = np.array(rows), np.array(target), np.array(weight)
    w /= w.sum()
    theta = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of the penalised logistic loss
        q = 1 / (1 + np.exp(-(x @ theta)))
        grad = x.T @ (w * (q - y)) + 1e-4 * theta
        hess = (x * (w * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        theta -= np.linalg.solve(hess, grad)
    return Classifier(theta, reliability, population)


def _count(batches):
    takes_over("pii")
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for at in range(0, batch.num_rows, 256):
            for text in batch.column(0).slice(at, 256).to_pylist():
                for kind, _, _, votes, _ in candidates(text, base_spans(text)) if text else ():
                    key = kind, ",".join(map(str, votes))
                    seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["kind", "votes", "n"])


def learn(df: DataFrame, text_col: str = "text") -> Classifier | None:
    """Train on the candidates of all texts."""
    small_batches(df.sparkSession)
    counted = df.select(F.col(text_col).cast("string")).mapInArrow(_count, "kind string, votes string, n long")
    found = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    return train({(r["kind"], tuple(map(int, r["votes"].split(",")))): r["n"] for r in found})


def spans_of(text: str | None, classifier: Classifier | None, threshold: float) -> tuple[list, list]:
    """(base spans, all spans) of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    if classifier is None:
        return base, base
    likely = [(classifier.probability(kind, votes), kind, a, b) for kind, a, b, votes, own in candidates(text, base) if not own]
    taken = list(base)
    for p, kind, a, b in sorted(likely, key=lambda c: (-c[0], c[2], -c[3], c[1])):
        if p >= threshold and not any(s < b and a < e for _, s, e in taken):
            taken.append((kind, a, b))
    return base, ordered(taken)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by the first one's kind in brackets."""
    out, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += (text[at:a], f"[{kind.upper()}]")
            end = b
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(classifier: Classifier | None, threshold: float, redacting: bool):
    def run(batches):
        takes_over("pii")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                found = [spans_of(t, classifier, threshold) for t in texts]
                counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in KINDS]
                hashes = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                clean = [[None if t is None else redact(t, every) if every else t for t, (_, every) in zip(texts, found, strict=True)]] if redacting else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array([joined(every) for _, every in found], pa.string()), *(pa.array(c, pa.string()) for c in clean), *(batch.column(c).slice(at, 256) for c in range(2, batch.num_columns))], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(["redacted"] * len(clean)), *batch.schema.names[2:]])

    return run


def find(df: DataFrame, classifier: Classifier | None, threshold: float = 0.6, redacting: bool = False, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans[, redacted], *extra) of every row."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"extra_{i}") for i, c in enumerate(extra)))
    kinds = "".join(f", extra_{i} {rows.schema[f'extra_{i}'].dataType.simpleString()}" for i in range(len(extra)))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + ", redacted string" * redacting + kinds
    return rows.mapInArrow(_find(classifier, threshold, redacting), schema).withColumnsRenamed({"id": id_col} | {f"extra_{i}": c for i, c in enumerate(extra)})
