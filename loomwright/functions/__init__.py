"""Column functions, all inside the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..kernel import price

def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else (lower() also folds letters like the Kelvin sign)."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _sum(parts: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total + of(x).cast("long"))


def heuristic_tokens(c: Column) -> Column:
    """The heuristic token estimate of a string (see kernel.price.heuristic), in the JVM."""
    words = _sum(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda x: F.floor((F.length(x) * 10 + 36) / 37))
    gaps = F.size(F.regexp_extract_all(c, F.lit(r"[ \t\n\f\r]{2,}"), F.lit(0)))
    marks = F.size(F.regexp_extract_all(c, F.lit(r"[\x00-\x08\x0B\x0E-\x1F!-/:-@\[-`{-\x7F]"), F.lit(0)))
    wide = _sum(F.regexp_extract_all(c, F.lit(r"[^\x00-\x7F]+"), F.lit(0)), lambda x: F.floor((F.octet_length(x) + 1) / 2))
    return (words + gaps + marks + wide).cast("long")


def byte_tokens(c: Column) -> Column:
    return F.octet_length(c).cast("long")


@dataclass(frozen=True)
class Estimator:
    """A pure price of a text: a column, the same in Python for the kernel, an id and a declared error in basis points."""

    name: str
    id: int
    column: Callable[[Column], Column]
    scalar: Callable[[str], int]
    over_claim_bps: int = 0


HEURISTIC = Estimator("heuristic", 0, heuristic_tokens, price.heuristic)
BYTES = Estimator("bytes", 1, byte_tokens, price.byte_length)
#: Exact vocabularies of these names have ids 2 and 3; 4 is reserved.
RESERVED_IDS = {"cl100k": 2, "o200k": 3, "hf": 4}
MEASURED_OVER_CLAIM_BPS = 600


def exact_estimator(name: str, path: str | None = None) -> Estimator:
    """An exact byte-pair estimator from a rank file; refused with a clear message if there is none."""
    if name not in ("cl100k", "o200k"):
        raise ValueError(f"no estimator {name!r}")
    if path is None:
        raise FileNotFoundError(f"the rank file of {name} is not part of this build: give its path")

    @F.pandas_udf(LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else exact_count(name, path, t)).astype("Int64")

    return Estimator(name, RESERVED_IDS[name], tokens, lambda t: exact_count(name, path, t))


# The published patterns by which the two vocabularies cut a text before they merge bytes.
PATTERNS = {
    "cl100k": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s",
    "o200k": "|".join(
        [
            r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
            r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
            r"\p{N}{1,3}",
            r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
            r"\s*[\r\n]+",
            r"\s+(?!\S)",
            r"\s+",
        ]
    ),
}
_loaded: dict = {}


def exact_count(name: str, path: str, text: str) -> int:
    """The tokens of a text, taken as ordinary content, under a vocabulary whose ranks a file holds."""
    if (name, path) not in _loaded:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[name, path] = tiktoken.Encoding(name, pat_str=PATTERNS[name], mergeable_ranks=ranks, special_tokens={})
    return len(_loaded[name, path].encode_ordinary(text))


def protected(c: Column) -> Column:
    """struct(class, literal) of the first protected literal in a text, or null."""
    # lower() is quick, and the two characters that it alone turns into ASCII letters are taken out before;
    # other letters do not matter, as every literal is ASCII
    low = F.lower(F.replace(F.replace(c, F.lit("\u212a"), F.lit("?")), F.lit("\u0130"), F.lit("?")))

    def first(x: Column) -> Column:
        out = None
        for name, literal, exact in price.RULES:
            found = F.struct(F.lit(name).alias("class"), F.lit(literal).alias("literal"))
            hit = F.contains(x["text"], F.lit(literal)) if exact else F.contains(x["low"], F.lit(price.lower(literal)))
            out = F.when(hit, found) if out is None else out.when(hit, found)
        return out

    # a list of one binds the folded text, which would else be made again for every literal
    return F.transform(F.array(F.struct(c.alias("text"), low.alias("low"))), first)[0]


def protected_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(price.RULES)], "ord int, class string, literal string, case_sensitive boolean")


# The names of encoder ids in reports and in protocol messages, and those of price ids.
ENCODER_NAMES = {"report": ("passthrough", "e1-minify", "e2-tabular", "e3-refs", "e4-jsonl", "e5-grid"), "message": ("passthrough", "minify", "tabular", "refs", "jsonl", "grid")}
PRICE_NAMES = ("heuristic", "byte-length", "cl100k-base", "o200k-base", "hugging-face")


def _named(number: Column, names: tuple[str, ...]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in enumerate(names) for x in pair])
    return F.when(number.isNotNull(), F.coalesce(F.try_element_at(known, number.cast("int")), F.lit("unknown")))


def encoder_name(number: Column, use: str = "report") -> Column:
    """The name of an encoder's id; `unknown` for ids of later builds."""
    return _named(number, ENCODER_NAMES[use])


def price_name(number: Column) -> Column:
    return _named(number, PRICE_NAMES)


def minify_plain(c: Column) -> Column:
    """White space outside strings removed, for valid JSON; strings stay as written."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s"]++'), F.lit(0)), "")


def framed(tag: str, body: Column) -> Column:
    return F.concat(F.lit(f"#tkfd1 {tag}\n"), body)


def uleb128_hex(n: Column) -> Column:
    """ULEB128 of a number below 2^63, as hex digits."""
    parts = []
    for k in range(9):
        rest = F.shiftrightunsigned(n.cast("long"), 7 * k)
        low = rest.bitwiseAND(F.lit(127).cast("long"))
        byte = F.when(F.shiftrightunsigned(n.cast("long"), 7 * k + 7) > 0, low + 128).otherwise(low)
        parts.append(F.when((rest > 0) | F.lit(k == 0), F.lpad(F.hex(byte), 2, "0")).otherwise(""))
    return F.concat(*parts)


def archive(content: Column) -> Column:
    """The recovery archive of a binary: header, checksum, original."""
    header = F.concat(F.lit("544B4644" + "01" + "00" + "0000" + "0000"), uleb128_hex(F.octet_length(content)), F.sha2(content, 256))
    return F.concat(F.unhex(header), content)


def archive_header_hex(content: Column) -> Column:
    return F.upper(F.concat(F.lit("544B4644" + "01" + "00" + "0000" + "0000"), uleb128_hex(F.octet_length(content)), F.sha2(content, 256)))


def ratio(after: Column, before: Column) -> Column:
    """after / before; 1.0 where there was nothing before."""
    return F.when(before == 0, F.lit(1.0)).otherwise(after / before)


def percent(part: Column) -> Column:
    return F.coalesce(F.format_string("%.2f%%", part * 100), F.lit("n/a"))


def clears_margin(after: Column, before: Column, bps: Column) -> Column:
    """Strictly cheaper, and by at least bps basis points of the price before; exact."""
    wide = lambda c: c.cast("decimal(38,0)")
    return (after < before) & ((wide(before) - wide(after)) * 10000 >= wide(before) * wide(bps))


def base64_strict(c: Column) -> Column:
    """The bytes of canonical base64 text, or null: length, alphabet, padding and trailing bits are checked."""
    shape = c.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    raw = F.try_to_binary(F.when(shape, c), F.lit("base64"))
    return F.when(F.regexp_replace(F.base64(raw), r"[\r\n]", "") == c, raw)


def base64_text(c: Column) -> Column:
    return F.regexp_replace(F.base64(c), r"[\r\n]", "")


def ascii_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A[ \t\n\f\r]+|[ \t\n\f\r]+\z", "")


def normalise_answer(c: Column) -> Column:
    """An answer as a sorted list: split at commas, without quotes and case, numbers in one spelling."""
    parts = F.transform(F.split(c, ","), lambda x: F.lower(F.trim(F.regexp_replace(F.trim(x), "^[\"'`]+|[\"'`]+$", ""))))
    number = lambda x: F.when(x.rlike(r"\A[+-]?[0-9]+(?:\.[0-9]+)?\z"), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\A\+", ""), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")).otherwise(x)
    return F.array_join(F.array_sort(F.filter(F.transform(parts, number), lambda x: x != "")), ",")
