"""Exact top-k by integer inner product, with multi-resolution segment statistics.

A vector is cut into equal segments; of each the mean and the standard deviation are kept, at 4, 8, 16 and
32 segments. For two vectors, the sum over segments of n (mean_q - mean_c)^2 + n (dev_q - dev_c)^2 is a
lower bound of the squared distance, and with the norms an upper bound of the inner product
(|q|^2 + |c|^2 - d^2) / 2 = sum of n (mean_q mean_c + dev_q dev_c). Candidates whose bound lies below a
query's k-th best score so far are dropped, coarse to fine; the others are scored exactly.

Queries and candidates are dealt into blocks. Every query is first searched in one block of candidates of its
length; its k-th best score there is the threshold with which all other blocks are searched, and a task that
goes through a block raises it further. A task holds one block of either kind and gives k rows a query at
most. Components are written in the fewest bytes that hold them (one for unit vectors), so the blocks that
are copied to every block of queries are smaller than their statistics would be.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of
different lengths are not compared; components are floor(scale * x) of any magnitude (scores beyond 2^52 are
summed up in Python integers); ties go to the smaller id; rows that repeat an id are candidates each, but
never of the query with that id, which asks with the greatest of its vectors in their written form; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, small_batches, takes_over

LEVELS = (4, 8, 16, 32)
QUERIES = 1024
CANDIDATES = 16_384
#: Candidates of a block that are looked at together.
SLICE = 2048


def quantised(v, scale: int) -> bytes | None:
    """floor(scale * x) of every component in the fewest bytes, behind the type's letter; None for a vector that takes no part."""
    if v is None or len(v) == 0 or any(c is None for c in v):
        return None
    x = np.asarray(v, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    top = np.abs(y).max()
    for letter, bits in (("b", 7), ("h", 15), ("i", 31)):
        if top < 2**bits:
            return letter.encode() + y.astype("<" + letter).tobytes()
    return b"o" + ",".join(str(int(c) if np.isfinite(c) else int(scale) * int(o)) for c, o in zip(y, x, strict=True)).encode()


def components(data: bytes) -> np.ndarray:
    """A written vector: as int64, or as Python integers."""
    if data[:1] == b"o":
        return np.array([int(c) for c in data[1:].split(b",")], dtype=object)
    return np.frombuffer(data, "<" + data[:1].decode(), offset=1).astype(np.int64)


def _quantise(scale: int):
    def run(batches):
        takes_over("topk")
        for batch in batches:
            rows = [(i, q, len(v)) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (q := quantised(v, scale)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "dim", "data"])

    return run


def _matrix(items) -> tuple[np.ndarray, np.ndarray]:
    vectors = [components(d) for d in items.field("data").to_pylist()]
    big = any(v.dtype == object for v in vectors)
    return items.field("id").to_numpy(zero_copy_only=False), np.array([[int(c) for c in v] for v in vectors], dtype=object) if big else np.array(vectors, np.int64)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that products of rows are upper bounds of inner products."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    root = [np.sqrt(p.shape[1]) for p in parts]
    return np.hstack([np.stack([p.mean(axis=1) * r for p, r in zip(parts, root, strict=True)], axis=1), np.stack([p.std(axis=1) * r for p, r in zip(parts, root, strict=True)], axis=1)])


def _best(row: np.ndarray, score: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: highest score, then smallest id."""
    order = np.lexsort((who, -score, row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], who[i])), np.int64)
    row, score, who = row[order], score[order], who[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], score[rank < k], who[rank < k]


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, counts: list[int] | None = None, least: list[int | None] | None = None) -> list[list[tuple[int, int]]]:
    """Of each query the k best (score, id) among the candidates but its own id, those below ``least`` left out.

    counts: gets the pairs that are left after each level.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in qid]
    if not len(qid) or not len(cid):
        return out
    top_q, top_c = max(1, int(np.abs(q).max())), max(1, int(np.abs(c).max()))
    exact = q.dtype != object and c.dtype != object and top_q * top_c * q.shape[1] < 2**52
    unit = lambda x, top: np.array([[v / top for v in row] for row in x], np.float64) if x.dtype == object else x / top
    fq, scale = unit(q, top_q), top_q * top_c
    floor = np.array([-np.inf if v is None else v / scale for v in least or [None] * len(qid)])
    slack = 1e-9 * q.shape[1]
    whole_q = q.astype(np.float64) if exact else None
    levels = [(s, statistics(fq, s)) for s in LEVELS if s < q.shape[1]]
    if counts is not None:
        counts[:] = [0] * len(levels)
    row, score, who = np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else object), np.zeros(0, np.int64)
    for at in range(0, len(cid), SLICE):
        ids, part = cid[at : at + SLICE], c[at : at + SLICE]
        fc = unit(part, top_c)
        alive = np.not_equal.outer(qid, ids)
        blank = np.flatnonzero(np.isinf(floor))
        if len(blank) and levels and len(ids) > k:
            # the k candidates of highest coarse bound give a query without threshold a first one
            bound = np.where(alive[blank], levels[0][1][blank] @ statistics(fc, LEVELS[0]).T, -np.inf)
            first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
            floor[blank] = np.where(np.take_along_axis(alive[blank], first, 1), np.einsum("qd,qkd->qk", fq[blank], fc[first]), -np.inf).min(axis=1) - slack
        for n, (s, a) in enumerate(levels):
            alive &= a @ statistics(fc, s).T >= floor[:, None] - slack
            if counts is not None:
                counts[n] += int(alive.sum())
        # what may come among the k best: not below the threshold, up to rounding
        if exact and 20 * np.count_nonzero(alive) > alive.size:
            # most pairs are left: one product of matrices scores them
            every = whole_q @ part.T.astype(np.float64)
            alive &= every >= (floor * scale * (1 - 1e-12) - 1)[:, None]
            x, y = np.nonzero(alive)
            new = every[x, y]
        else:
            x, y = np.nonzero(alive)
            near = np.einsum("nd,nd->n", fq[x], fc[y]) >= floor[x] - slack
            x, y = x[near], y[near]
            new = np.einsum("nd,nd->n", whole_q[x], part[y].astype(np.float64)) if exact else np.array([sum(int(a) * int(b) for a, b in zip(q[i], part[j], strict=True)) for i, j in zip(x, y, strict=True)], dtype=object)
        row, score, who = _best(np.concatenate([row, x]), np.concatenate([score, new]), np.concatenate([who, ids[y]]), k)
        # a query with k results has the last one's score as its threshold
        last = np.flatnonzero(np.bincount(row, minlength=len(qid)) == k)
        floor[last] = np.maximum(floor[last], [float(score[np.searchsorted(row, i, "right") - 1] / scale) for i in last])
    for i, s, w in zip(row.tolist(), score.tolist(), who.tolist(), strict=True):
        out[i].append((int(s), w))
    return out


def _searcher(k: int):
    def run(batches):
        takes_over("topk")
        for batch in batches:
            for row in range(batch.num_rows):
                items = batch.column(0)[row].values
                qid, q = _matrix(items)
                least = [None if v is None else int(v) for v in items.field("least").to_pylist()]
                cid, c = _matrix(batch.column(1)[row].values)
                found = search(qid, q, cid, c, k, least=least)
                query = [int(i) for i, best in zip(qid, found, strict=True) for _ in best]
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array([i for best in found for _, i in best], pa.int64()), pa.array([str(s) for best in found for s, _ in best], pa.string())], names=["query_id", "vec_id", "score"])

    return run


def _numbered(df: DataFrame, per: int, salt: int) -> DataFrame:
    """Blocks of about ``per`` rows by hash, of one length of vectors."""
    n = small(df.groupBy("dim").agg(F.count("*").alias("n")))  # the lengths of vectors are few
    return df.join(n, "dim").withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "uid"), F.ceil(F.col("n") / per).cast("long"))).drop("n")


def nearest(df: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest score of each row that ``queries`` holds for.

    score is a long, or a decimal without places if ``scale`` and the components make it larger than that.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    data = rows.select("id", "v").mapInArrow(_quantise(scale), "id long, dim int, data binary")
    data = materialize(data.withColumn("uid", F.monotonically_increasing_id()), "quantised")
    ask = data.join(rows.where("asked").select("id").distinct(), "id").groupBy("id").agg(F.max(F.struct("data", "dim")).alias("x")).select("id", "x.dim", "x.data", F.col("id").alias("uid"))
    ask = materialize(_numbered(ask, QUERIES, 5), "queries")
    every = _numbered(data, CANDIDATES, 6).groupBy("dim", "block").agg(F.collect_list(F.struct("id", "data")).alias("b"))
    every = materialize(every, "candidates")
    width = 4 * max(1, spark.sparkContext.defaultParallelism)

    def searched(asked: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
        a = asked.groupBy("dim", F.col("block").alias("qb")).agg(F.collect_list(F.struct("id", "data", "least")).alias("a"))
        tasks = a.join(blocks, "dim").repartition(width, "qb", "block").select("a", "b")
        return materialize(tasks.mapInArrow(_searcher(k), "query_id long, vec_id long, score string").withColumn("score", F.col("score").cast("decimal(38,0)")), name)

    first = searched(ask.withColumn("least", F.lit(None).cast("decimal(38,0)")), every.where("block = 0"), "first")
    least = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select(F.col("query_id").alias("id"), "least")
    rest = searched(ask.join(least, "id", "left"), every.where("block > 0"), "rest")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = first.union(rest).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
