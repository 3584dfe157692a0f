"""Language identification with error-correcting output codes over byte n-grams.

Each learned language gets a codeword; one linear classifier per bit of the codewords is trained on
hashed 1- to 3-byte n-grams of the lower-cased text (log counts, unit length). Up to seven languages use
the exhaustive code of 2^(k-1) - 1 bits, more use the random code, of many drawn from a seed, whose
codewords lie furthest apart. A text gets the codeword with the least loss: the exponential loss of
each bit's margin, weighted by how well that bit was predicted on the training rows. The score is the
winner's share under a softmax of the losses; a text is flagged ambiguous if the runner-up is close.

Every language is learned. Training takes about ``per_lang`` documents of each, fewer if all together
would be more than ``rows`` (those whose hash of id, text and language lies lowest; repeated rows count
once), the documented bound of what reaches the driver; prediction reads every whole text. More than
``MAX_LANGS`` languages are refused: that is no column of languages.

Edge cases: a text that is null or has no letter gets `und` with score 0; without labelled rows every
text gets `und`; with one learned language every text with a letter gets it with score 1; languages of
equal shares give the first by code point; rows that repeat are told alike; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, small_batches, takes_over

UND = "und"
MAX_LANGS = 4096
DIM = 1 << 13
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def features(text: str) -> np.ndarray:
    """Hashed log counts of the 1-, 2- and 3-byte n-grams of the lower-cased text, of unit length."""
    return scaled(counts(text))


def counts(text: str) -> np.ndarray:
    total = np.zeros(DIM, np.int64)
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
    for at in range(0, len(raw), 1 << 20):  # long texts in slices, the n-grams across their ends included
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        own = min(len(b), 1 << 20)
        grams = [b[:own]]
        if len(b) > 1:
            grams.append((b[:-1] * np.uint32(0x01000193) ^ b[1:] * np.uint32(0x9E3779B1) ^ np.uint32(0x5BD1E995))[:own])
        if len(b) > 2:
            grams.append((b[:-2] * np.uint32(0x85EBCA6B) ^ b[1:-1] * np.uint32(0xC2B2AE35) ^ b[2:] * np.uint32(0x27D4EB2F) ^ np.uint32(0x165667B1))[:own])
        for g in grams:
            g = g * np.uint32(0x9E3779B1)
            total += np.bincount((g ^ (g >> np.uint32(15))) & np.uint32(DIM - 1), minlength=DIM)
    return total


def scaled(total: np.ndarray) -> np.ndarray:
    x = np.log1p(total)
    return (x / max(np.sqrt((x * x).sum()), 1e-12)).astype(np.float32)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of -1 and 1."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        n = 2 ** (k - 1) - 1
        rest = (np.arange(n)[None, :] >> np.arange(k - 1)[::-1, None]) & 1
        return np.vstack([np.ones(n), rest * 2.0 - 1])
    rng, best, apart = np.random.default_rng(seed), None, -1
    bits = math.ceil(10 * math.log2(k))
    for _ in range(200):
        code = rng.integers(0, 2, (k, bits)) * 2.0 - 1
        code = code[:, np.abs(code.sum(axis=0)) < k]
        gap = (code.shape[1] - (code @ code.T - np.diag(np.full(k, 3.0 * bits))).max()) / 2
        if gap > apart:
            best, apart = code, gap
    return best


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    sharpness: float

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Of each row of features, the share of each language."""
        margin = np.clip(x @ self.weights + self.bias, -4, 4)
        loss = np.stack([(np.exp(-margin * word) * self.trust).sum(axis=1) for word in self.code], axis=1) / self.trust.sum()
        z = -self.sharpness * (loss - loss.min(axis=1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: list[str], steps: int = 300, decay: float = 1e-5) -> Model:
    """Train the bit classifiers: logistic loss, balanced over languages, Nesterov's gradient."""
    langs = tuple(sorted(set(y)))
    k = len(langs)
    code = codewords(k)
    which = np.array([langs.index(v) for v in y])
    weight = 1 / (k * np.bincount(which, minlength=k)[which])
    target = code[which].astype(np.float32)
    x = x.astype(np.float32, copy=False)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if k > 1:
        lw, lb, rate = w, b, np.float32(8.0)
        for step in range(steps):
            mix = np.float32(step / (step + 3))
            vw, vb = w + mix * (w - lw), b + mix * (b - lb)
            slope = -target / (1 + np.exp(np.clip(target * (x @ vw + vb), -30, 30))) * weight[:, None].astype(np.float32)
            lw, lb = w, b
            w, b = vw - rate * (x.T @ slope + np.float32(decay) * vw), vb - rate * slope.sum(axis=0)
    right = ((x @ w + b) * target > 0) * weight[:, None]
    trust = np.maximum(right.sum(axis=0) - 0.5, 1e-3) if k > 1 else np.ones(1)
    return Model(langs, code, w, b, trust, 6.0)


def _featurise(batches):
    takes_over("language_id")
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            # most counts are 0 or small: compressed, a row is a tenth of its features on the way to the driver
            x = [zlib.compress(counts(t).astype("<u4").tobytes(), 1) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(x, pa.binary())], names=["lang", "h", "x"])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 800, rows: int = 51_200) -> Model | None:
    """Fit on a bounded sample of the labelled rows of ``df``; None if there are none."""
    spark = df.sparkSession
    small_batches(spark)
    told = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    counts = told.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages in column {lang_col}")
    if not counts:
        return None
    # of n rows, so many lie below this bound of a uniform hash as are wanted
    want = min(per_lang, max(1, rows // len(counts)))
    bounds = spark.createDataFrame([(r["lang"], 2**64 * min(want, r["count"]) // r["count"] - 2**63 - 1) for r in counts], "lang string, bound long")
    hashed = told.withColumn("h", F.xxhash64(F.lit(3), "id", "text", "lang")).join(small(bounds), "lang").where("h <= bound")
    once = hashed.where(F.col("text").rlike(r"\p{L}")).groupBy("lang", "h").agg(F.first("text").alias("text"))
    got = once.select("text", "lang", "h").mapInArrow(_featurise, "lang string, h long, x binary").limit(2 * rows).toArrow()
    if not got.num_rows:
        return None
    langs, hashes = got["lang"].to_pylist(), got["h"].to_numpy()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], hashes[i]))
    # the matrix is the largest thing on the driver: it is filled in place, row by row
    x, to = np.empty((len(langs), DIM), np.float32), np.argsort(order)
    at = 0
    for chunk in got["x"].chunks:
        for row in chunk:
            x[to[at]] = scaled(np.frombuffer(zlib.decompress(row.as_buffer()), "<u4"))
            at += 1
    del got
    return fit(x, [langs[i] for i in order])


def _predictor(model: Model | None, closeness: float, with_text: bool):
    first = 1 if with_text else 2

    def run(batches):
        takes_over("language_id")
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, texts = batch.column(0).slice(at, 128), batch.column(1).slice(at, 128).to_pylist()
                lang, score, unsure = [UND] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if model is not None and (some := [i for i, t in enumerate(texts) if has_letter(t)]):
                    shares = model.shares(np.array([features(texts[i]) for i in some]))
                    order = np.sort(shares, axis=1)
                    for i, row, best in zip(some, shares, order, strict=True):
                        lang[i], score[i] = model.langs[int(row.argmax())], float(min(1.0, best[-1]))
                        unsure[i] = len(best) > 1 and bool(best[-2] > closeness * best[-1])
                yield pa.RecordBatch.from_arrays([ids, pa.array(lang), pa.array(score, pa.float64()), pa.array(unsure), *(batch.column(c).slice(at, 128) for c in range(first, batch.num_columns))], names=["id", "lang_pred", "score", "ambiguous", *batch.schema.names[first:]])

    return run


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", closeness: float = 0.8, extra: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous[, text], *extra) of every row of ``df``."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"extra_{i}") for i, c in enumerate(extra)))
    kept = (["text"] if with_text else []) + [f"extra_{i}" for i in range(len(extra))]
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    id_kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_predictor(model, closeness, with_text), f"id {id_kind}, lang_pred string, score double, ambiguous boolean{kinds}")
    return out.withColumnsRenamed({"id": id_col, "text": text_col} | {f"extra_{i}": c for i, c in enumerate(extra)})


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), learned from the rows that are not held out."""
    model = train(df.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(df, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "ambiguous")
