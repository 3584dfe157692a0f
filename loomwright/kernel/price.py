"""Token estimates and the literals that are never folded away, for one text."""

from __future__ import annotations

import re
import string

# The protected literals in order of precedence (the first that occurs decides the class).
RULES = (
    ("compiler", "error[", False),
    ("compiler", "error:", False),
    ("compiler", "error TS", False),
    ("http-status", "400 Bad Request", False),
    ("http-status", "401 Unauthorized", False),
    ("http-status", "403 Forbidden", False),
    ("http-status", "404 Not Found", False),
    ("http-status", "405 Method Not Allowed", False),
    ("http-status", "408 Request Timeout", False),
    ("http-status", "409 Conflict", False),
    ("http-status", "410 Gone", False),
    ("http-status", "422 Unprocessable", False),
    ("http-status", "429 Too Many Requests", False),
    ("http-status", "500 Internal Server Error", False),
    ("http-status", "501 Not Implemented", False),
    ("http-status", "502 Bad Gateway", False),
    ("http-status", "503 Service Unavailable", False),
    ("http-status", "504 Gateway Timeout", False),
    ("errno", "EACCES", True),
    ("errno", "EPERM", True),
    ("errno", "EROFS", True),
    ("panic", "panicked at", False),
    ("panic", "panic:", False),
    ("stack-trace", "Traceback (most recent call last)", False),
    ("stack-trace", "stack backtrace:", False),
    ("stack-trace", "goroutine ", False),
    ("denial", "denied", False),
    ("authz", "unauthorized", False),
    ("authz", "forbidden", False),
    ("certificate", "certificate verify failed", False),
    ("certificate", "certificate verification failed", False),
    ("certificate", "certificate has expired", False),
    ("certificate", "certificate is not valid", False),
    ("certificate", "self-signed certificate", False),
    ("certificate", "self signed certificate", False),
    ("certificate", "unable to get local issuer certificate", False),
    ("certificate", "SSL certificate problem", False),
    ("certificate", "x509: certificate", False),
    ("certificate", "tls: bad certificate", False),
    ("warning", "warning:", False),
)
RULES_VERSION = 1

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_LITERALS = [(name, literal if exact else literal.translate(_LOWER), exact) for name, literal, exact in RULES]
_ANY = re.compile("|".join(re.escape(x) for _, x, exact in _LITERALS if not exact))
_EXACT = re.compile("|".join(re.escape(x) for _, x, exact in _LITERALS if exact))

_WORD = re.compile(r"[A-Za-z0-9]+")
_GAP = re.compile(r"[ \t\n\f\r]{2,}")
_MARK = re.compile(r"[\x00-\x08\x0B\x0E-\x1F!-/:-@\[-`{-\x7F]")
_WIDE = re.compile(r"[^\x00-\x7F]+")


def lower(text: str) -> str:
    """A-Z in lower case, nothing else."""
    return text.translate(_LOWER)


def protected(text: str) -> tuple[str, str] | None:
    """Class and literal of the first rule that occurs in the text."""
    low = lower(text)
    if not _ANY.search(low) and not _EXACT.search(text):
        return None
    return next((RULES[i][:2] for i, (_, literal, exact) in enumerate(_LITERALS) if literal in (text if exact else low)), None)


def heuristic(text: str) -> int:
    """Runs of letters and digits cost a token per 3.7 characters, other ASCII characters one each, white space from two on one, the rest one per two bytes."""
    words = sum((len(w) * 10 + 36) // 37 for w in _WORD.findall(text))
    wide = sum((len(w.encode()) + 1) // 2 for w in _WIDE.findall(text)) if not text.isascii() else 0
    return words + len(_GAP.findall(text)) + len(_MARK.findall(text)) + wide


def byte_length(text: str) -> int:
    return len(text.encode())


ESTIMATORS = {"heuristic": heuristic, "bytes": byte_length}
