"""Near-copy join on word 5-grams: banded MinHash candidates, Bayesian pruning, exact verification.

A document's shingles are the runs of five words of its whole text (words: maximal runs of characters
that are no white space, lower-cased; a text of one to four words is one shingle). Documents with the
same words form one class, of which the smallest doc_id stands for the rest. 128 MinHash values are
taken of each; 20 bands of 5 values give candidates (a pair at 0.8 meets with probability 0.9996).
A candidate's values are compared 16 at a time; after m equal ones of n the similarity has the
posterior Beta(m+1, n-m+1) under a flat prior, and the pair is dropped as soon as the probability of
reaching the threshold falls below ``tolerance``. The rest are verified on the whole shingle sets, held as
64-bit fingerprints.
Distances 1 - J obey the triangle inequality, by which cover.py spares the pairs inside large groups.

Edge cases: null, empty and white-space texts have no shingles and link with nothing; rows repeating a
doc_id count once per distinct text and the id gets the links of its smallest class; rows without doc_id
are left out; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType

from .common import lists, materialize, small, small_batches, takes_over
from .cover import MARGIN, Metric, links

SHINGLE = 5
VALUES = 128
BANDS, ROWS = 20, 5
STEP = 16


@lru_cache(maxsize=1)
def _family():
    rng = np.random.default_rng(977)
    odd = lambda n, kind, top: rng.integers(0, top, n, dtype=kind) | kind(1)
    return odd(SHINGLE, np.uint64, 2**63), odd(VALUES, np.uint32, 2**32 - 1), rng.integers(0, 2**32 - 1, VALUES, dtype=np.uint32), odd(ROWS, np.uint64, 2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def fingerprints(words: list[str]) -> np.ndarray:
    """64-bit fingerprints of the shingles of a non-empty list of words, in order."""
    place = _family()[0]
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        h = np.array([(w * place[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64)
    else:
        h = sum((w[j : len(w) - SHINGLE + 1 + j] * place[j] for j in range(SHINGLE)), np.uint64(0))
    return _mix(h)


def signature(words: list[str]) -> np.ndarray:
    """MinHash values of a non-empty list of words."""
    return minhash(fingerprints(words))


def minhash(prints: np.ndarray) -> np.ndarray:
    _, a, b, _ = _family()
    x = (prints >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at : at + 1024, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    mix = _family()[3]
    cells = signatures[:, : BANDS * ROWS].astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    return _mix((_mix(cells + np.uint64(5)) * mix).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sign(batches):
    takes_over("jaccard_join")
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            place, rows = [], []
            for n, (i, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                if words := words_of(text):
                    digest = xxhash.xxh3_128_digest(" ".join(words))
                    place.append(n)
                    rows.append((i, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), signature(words)))
            if rows:
                sig = np.array([r[3] for r in rows])
                keys = band_keys(sig)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[c] for r in rows], pa.int64()) for c in range(3)), pa.array([s.tobytes() for s in sig], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(keys.ravel())), *(c.take(pa.array(place)) for c in part.columns[2:])],
                    names=["id", "d1", "d2", "sig", "keys", *batch.schema.names[2:]],
                )


@lru_cache(maxsize=256)
def least_equal(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each n = STEP, 2 STEP, ...: the fewest equal values with which a pair goes on.

    The posterior probability of J >= t after m of n is that of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        ks = np.arange(n + 1, dtype=np.float64)
        logs = np.array([0.0, *np.cumsum(np.log((n + 1 - ks) / (ks + 1)))])
        t = min(max(threshold, 1e-9), 1 - 1e-9)
        js = np.arange(n + 2)
        tail = np.cumsum(np.exp(logs + js * np.log(t) + (n + 1 - js) * np.log1p(-t)))
        out.append(int(np.searchsorted(tail[: n + 1], tolerance)))
    return tuple(out)


def may_reach(a: bytes, b: bytes, threshold: float, tolerance: float) -> bool:
    equal = np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)
    return all(equal[: (k + 1) * STEP].sum() >= least for k, least in enumerate(least_equal(threshold, tolerance)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct fingerprints."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


@F.arrow_udf(ArrayType(LongType()))
def fingerprint_sets(text: pa.Array) -> pa.Array:
    return pa.array([np.unique(fingerprints(words_of(t))).view(np.int64) for t in text.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(DoubleType())
def jaccard_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([1 - similarity(x, y) for x, y in zip(lists(a), lists(b), strict=True)], pa.float64())


@F.arrow_udf(DoubleType())
def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(x, y) for x, y in zip(lists(a), lists(b), strict=True)], pa.float64())


@F.arrow_udf(ArrayType(LongType()))
def keys_of(prints: pa.Array) -> pa.Array:
    return pa.array([band_keys(minhash(p.view(np.uint64))[None])[0] for p in lists(prints)], pa.list_(pa.int64()))


def undecided(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (x, y) of signatures those that the pruning keeps, STEP values at a time."""
    equal = np.zeros(len(x), np.int64)
    for k, fewest in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        equal += (a[x, part] == b[y, part]).sum(axis=1)
        kept = equal >= fewest
        x, y, equal = x[kept], y[kept], equal[kept]
    return x, y


def block_linker(threshold: float, tolerance: float):
    """Links between the items of two blocks: by the triangle inequality where it decides, else by pruning and their shingles.

    A group has very many pairs near the threshold, so the tolerance given here is the smaller one.
    """
    limit = 1 - threshold
    least = least_equal(threshold, tolerance)

    def run(batches):
        takes_over("jaccard_join")
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(2)[row].as_py()
                parts = []
                for c in (0, 1):
                    items = batch.column(c)[row].values
                    parts.append((items.field("id").to_numpy(), items.field("r").to_numpy(), items.field("weight").to_numpy(), [f.values.to_numpy() for f in items.field("feat")]))
                (ia, ra, wa, fa), (ib, rb, wb, fb) = parts
                total = ra[:, None] + rb[None, :]
                link = total <= limit - MARGIN
                na, nb = np.array([len(f) for f in fa]), np.array([len(f) for f in fb])
                open_ = ~link & (np.abs(ra[:, None] - rb[None, :]) <= limit + MARGIN)
                open_ &= np.minimum(na[:, None], nb[None, :]) >= threshold * np.maximum(na[:, None], nb[None, :])
                if same:
                    open_ = np.triu(open_, 1)
                x, y = np.nonzero(open_)
                if len(x):
                    sa, sb = (np.stack([minhash(f.view(np.uint64)) for f in fs]) for fs in (fa, fb))
                    for i, j in zip(*undecided(sa, sb, x, y, least), strict=True):
                        link[i, j] = similarity(fa[i], fb[j]) >= threshold
                if same:
                    link = np.triu(link, 1)
                    link |= link.T
                counts = {}
                for i, w in zip(ia, link @ wb, strict=True):
                    counts[i] = counts.get(i, 0) + w
                if not same:
                    for j, w in zip(ib, wa @ link, strict=True):
                        counts[j] = counts.get(j, 0) + w
                root = {}

                def find(v, root=root):
                    while (up := root.setdefault(v, v)) != v:
                        root[v] = root[up]
                        v = root[v]
                    return v

                edges = []
                for x, y in np.argwhere(link):
                    a, b = find(ia[x]), find(ib[y])
                    if a != b:
                        root[a] = b
                        edges.append((ia[x], ib[y]))
                counts = [(i, w) for i, w in counts.items() if w]
                yield pa.RecordBatch.from_arrays([pa.array([*(i for i, _ in counts), *(i for i, _ in edges)], pa.int64()), pa.array([*(w for _, w in counts), *([None] * len(edges))], pa.int64()), pa.array([*([None] * len(counts)), *(j for _, j in edges)], pa.int64())], names=["i", "w", "j"])

    return run


def majority(rest: DataFrame) -> DataFrame:
    """The shingles that more than half the items of a centre have, for centres with three items or more."""
    size = rest.groupBy("centre").agg(F.count("*").alias("n")).where("n > 2")
    each = rest.select("centre", F.explode("feat").alias("s")).groupBy("centre", "s").agg(F.count("*").alias("c"))
    return each.join(size, "centre").where("2 * c > n").groupBy("centre").agg(F.collect_list("s").alias("feat"), F.first("n").alias("n"))


def pruner(tolerance: float):
    @F.arrow_udf(BooleanType())
    def keep(a: pa.Array, b: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([x is None or y is None or may_reach(x, y, z, tolerance) for x, y, z in zip(a.to_pylist(), b.to_pylist(), t.to_pylist(), strict=True)], pa.bool_())

    return keep


def near_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-4, votes: int = 4, marks: tuple[str, ...] = ()) -> DataFrame:
    """(id, *marks, class_id, n_links, n_copies) of every row with an id and a word, repeated rows once.

    ``marks`` are long columns that tell rows of one id apart, such as hashes of their texts.
    """
    small_batches(df.sparkSession)
    named_marks = [F.col(c).cast("long").alias(f"mark_{i}") for i, c in enumerate(marks)]
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *named_marks).where("id is not null")
    own = [f"mark_{i}" for i in range(len(marks))]
    signed = materialize(base.mapInArrow(_sign, "id long, d1 long, d2 long, sig binary, keys array<long>" + "".join(f", {c} long" for c in own)), "signatures")
    base = base.select("id", "text")
    # a class is named by a number of its own, not by a part of its digest
    classes = signed.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("weight"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    reps = signed.join(classes, ["d1", "d2"]).where("id = rep").select(F.col("class").alias("id"), "d1", "d2", "rep", "weight", "sig", "keys")
    items = materialize(reps.dropDuplicates(["id"]), "items")
    limit = 1 - threshold
    keep = pruner(tolerance)
    sig = items.select("id", "sig")

    def prune(pairs: DataFrame) -> DataFrame:
        least = F.greatest(F.lit(0.02), F.floor((1 - limit - F.col("ra") - F.col("rb")) * 50) / 50)
        a, b = (sig.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        both = pairs.join(a, "a", "left").join(b, "b", "left")
        return both.where(keep(F.col("sig_a"), F.col("sig_b"), least)).drop("sig_a", "sig_b")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = small(items.join(ids, "id").select(F.col("id").alias("class"), F.col("rep").alias("id"), "d1", "d2"))
        held = base.join(wanted, "id").where(same_words(F.col("text"), F.col("d1"), F.col("d2")))
        return held.groupBy(F.col("class").alias("id")).agg(F.max("text").alias("text")).select("id", fingerprint_sets("text").alias("feat"))

    metric = Metric(jaccard_distance, lambda a, b: jaccard(a, b) >= threshold, limit, prune, consensus=majority, centre_keys=keys_of, block=block_linker(threshold, tolerance / 100))
    found = links(items.select("id", F.explode("keys").alias("key")), texts, items.select("id", "weight"), metric, votes)
    named = found.join(items.select("id", "rep"), "id")
    # components are named by classes until here; their name is the smallest doc_id
    names = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = named.join(names, "component").select(F.col("id").alias("class"), "n_links", "class_id")
    by_class = classes.join(named, "class", "left").select("d1", "d2", "weight", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    member = signed.select("id", "d1", "d2", *own).distinct().join(by_class, ["d1", "d2"])
    return member.select("id", *[F.col(f"mark_{i}").alias(c) for i, c in enumerate(marks)], "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("weight").cast("long").alias("n_copies"))


def near_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-4, votes: int = 4) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every distinct id.

    n_links: other documents with similarity >= threshold, copies included; class_id: the smallest
    doc_id reachable by links; n_copies: documents with the same words, itself included.
    """
    each = near_texts(df, id_col, text_col, threshold, tolerance, votes).groupBy("id").agg(F.min(F.struct("class_id", "n_links", "n_copies")).alias("x"))
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    return ids.join(each, "id", "left").select(F.col("id").alias(id_col), F.coalesce("x.class_id", "id").alias("class_id"), F.coalesce("x.n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("x.n_copies", F.lit(1)).cast("long").alias("n_copies"))


@F.arrow_udf(BooleanType())
def same_words(text: pa.Array, d1: pa.Array, d2: pa.Array) -> pa.Array:
    def digest(t: str) -> tuple[int, int]:
        x = xxhash.xxh3_128_digest(" ".join(words_of(t)))
        return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)

    return pa.array([t is not None and digest(t) == (a, b) for t, a, b in zip(text.to_pylist(), d1.to_pylist(), d2.to_pylist(), strict=True)], pa.bool_())
