"""Packing token sequences by non-negative least squares over length combinations.

A document's ids (with the end id) are cut into full windows, each a sequence of its own, and a
remainder. The histogram of remainder lengths has fewer bins than the window, so the plan is made on the
driver whatever the corpus: combinations of two or three lengths that fill the window are enumerated,
their repeat counts solved for in the non-negative least-squares sense against the histogram, and
rounded down. The lengths that are left are packed greedily, longest first, each gap filled by the
longest length that fits; a gap that none fits is filled by cutting a longer remainder, so that little
padding stays. The plan names ranges of ranks within each length; a document finds its sequence by its
rank, which is counted in hash blocks (common.running), so a hot length is no bottleneck.

Edge cases: a null or empty text is the end id alone; rows that repeat a doc_id are packed each; a
sequence is padded to the window, except where its length is a power of two; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import lets_go, materialize, running, small, small_batches, takes_over
from .tokens import encoder

WINDOW = 1024


@dataclass
class Lot:
    """Ranks first .. first + count of remainders of one length, of which [start, stop) is still to be packed."""

    length: int
    first: int
    count: int
    start: int
    stop: int


@dataclass
class Plan:
    window: int
    #: (length, first rank, end rank, start, stop, first sequence, offset)
    slots: list[tuple[int, int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All twos and threes of the lengths that fill the window, longest first; zero: none."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a, b = np.meshgrid(lengths, np.append(lengths, 0), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    fits = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[fits], b[fits], c[fits]
    whole = (c == 0) & (b > 0) | have[c] & (c > 0)
    return np.stack([a[whole], b[whole], c[whole]], axis=1).astype(np.int64)


def solve(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with least |A x - h|, by accelerated projected gradients; A has a column for each pattern."""
    n = len(histogram)
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    used = patterns > 0

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(patterns[used], weights=np.repeat(v, used.sum(axis=1)), minlength=n)[:n]

    def back(r: np.ndarray) -> np.ndarray:
        return (r[patterns] * used).sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(forward(v))
        v /= np.sqrt((v * v).sum())
    rate = 1 / max(np.sqrt((back(forward(v)) ** 2).sum()) * 1.05, 1e-12)
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(forward(y) - histogram))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """The packing of ``histogram[length]`` remainders of each length."""
    out = Plan(window)
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    lots = {int(k): [Lot(int(k), 0, int(counts[k]), 0, int(k))] for k in np.flatnonzero(counts)}

    def take(length: int, times: int, at: int) -> None:
        """Put pieces of a length at an offset of the next ``times`` sequences."""
        done = 0
        while done < times:
            lot = lots[length][-1]
            n = min(times - done, lot.count)
            out.slots.append((lot.length, lot.first, lot.first + n, lot.start, lot.stop, out.sequences + done, at))
            lot.first, lot.count, done = lot.first + n, lot.count - n, done + n
            if not lot.count:
                lots[length].pop()
        counts[length] -= times

    patterns = combinations(np.flatnonzero(counts[1:window]) + 1, window)
    repeats = np.floor(solve(patterns, counts.astype(float)[: window + 1]) + 1e-6).astype(np.int64)
    for row in np.argsort(-repeats, kind="stable"):
        lengths = [int(k) for k in patterns[row] if k]
        times = min([int(repeats[row]), *(int(counts[k]) // lengths.count(k) for k in lengths)])
        if times > 0:
            at = 0
            for k in lengths:
                take(k, times, at)
                at += k
            out.sequences += times
    while counts.any():
        # longest first; the gap takes the longest that fits, as often as all of them last
        lengths, gap = [], window
        left = counts.copy()
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            k = int(fits[-1])
            lengths.append(k)
            left[k] -= 1
            gap -= k
        times = min(int(counts[k]) // lengths.count(k) for k in set(lengths))
        longer = np.flatnonzero(left) if gap else []
        if gap and len(longer):
            # cut the gap's length off the longest that is left
            k = int(longer[-1])
            need = lengths.count(k) + 1
            times = min(times, max(1, int(counts[k]) // need))
            done = 0
            while done < times:
                lot = lots[k][-1]
                n = min(times - done, lot.count)
                lots.setdefault(gap, []).append(Lot(lot.length, lot.first, n, lot.start, lot.start + gap))
                lots.setdefault(k - gap, []).append(Lot(lot.length, lot.first, n, lot.start + gap, lot.stop))
                lot.first, lot.count, done = lot.first + n, lot.count - n, done + n
                if not lot.count:
                    lots[k].pop()
            counts[k] -= times
            counts[gap] += times
            counts[k - gap] += times
            lengths.append(gap)
        at = 0
        for k in lengths:
            take(k, times, at)
            at += k
        out.sequences += times
    return out


def _tokenise(path: str, end_id: int, window: int):
    def run(batches):
        takes_over("tokens")
        enc = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            coded = [x + end for x in enc.encode(batch.column(1).to_pylist())]
            n = [len(x) // 4 for x in coded]
            full = [[zlib.crc32(x[4 * window * k : 4 * window * (k + 1)]) for k in range(m // window)] for x, m in zip(coded, n, strict=True)]
            tail = [x[4 * window * (m // window) :] for x, m in zip(coded, n, strict=True)]
            small_ids = [np.frombuffer(x, "<u4") for x in tail]
            packed = [x.astype("<u2").tobytes() if not len(x) or x.max() < 65536 else x.tobytes() for x in small_ids]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array([len(x) // 4 for x in tail], pa.int32()), pa.array([zlib.crc32(x) for x in tail], pa.int64()), pa.array(packed, pa.binary())],
                names=["id", "n", "full", "rem", "rem_crc", "rem_ids"],
            )
        del enc
        lets_go("tokens")

    return run


@F.arrow_udf(LongType())
def _piece_crc(ids: pa.Array, rem: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
    rows = zip(ids.to_pylist(), rem.to_pylist(), start.to_pylist(), stop.to_pylist(), strict=True)
    return pa.array([zlib.crc32(np.frombuffer(x, "<u2" if len(x) == 2 * r else "<u4")[a:b].astype("<u4").tobytes()) for x, r, a, b in rows], pa.int64())


def pack(df: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to) of every piece."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    coded = rows.mapInArrow(_tokenise(tokenizer, end_id, window), f"id {kind}, n long, full array<long>, rem int, rem_crc long, rem_ids binary")
    # written once: from here on a row keeps its number
    coded = materialize(coded.withColumn("uid", F.monotonically_increasing_id()), "ids")
    found = coded.where("rem > 0").groupBy("rem").agg(F.count("*").alias("n")).collect()
    made = plan({r["rem"]: r["n"] for r in found}, window)
    schema = "rem int, first long, end long, from int, to int, base long, offset long"
    slots = small(spark.createDataFrame(made.slots, schema))
    slim = running(coded.select("uid", "id", "n", "rem", "rem_crc").where("rem > 0"), "rem", "uid", "rank")
    put = slim.join(slots, "rem").where("rank >= first and rank < end").withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("first"))
    put = materialize(put.select("uid", "id", "n", "rem", "rem_crc", "from", "to", "sequence_id", "offset"), "pieces")
    start = F.col("n") - F.col("rem") + F.col("from")
    shape = lambda crc: [F.col("id"), start.cast("long").alias("start"), (F.col("to") - F.col("from")).cast("long").alias("length"), crc.alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset"]
    whole = put.where("to - from = rem").select(*shape(F.col("rem_crc")))
    cut = put.where("to - from < rem").join(coded.select("uid", "rem_ids"), "uid")
    cut = cut.select(*shape(_piece_crc("rem_ids", "rem", "from", "to")))
    long = coded.where(F.size("full") > 0).select("uid", "id", "n", "full", F.size("full").cast("long").alias("k"))
    long = running(long, None, "uid", "before", "k").select("id", "n", "before", F.posexplode("full").alias("place", "crc"))
    long = long.select("id", (F.col("place") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("before") + F.col("place") + made.sequences).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.union(cut).union(long).withColumnRenamed("id", id_col)
