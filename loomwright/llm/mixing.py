"""Mixing sources to target weights by a splitting tree over exact block quotas.

Targets: the sources' shares of all words follow their weights; a source stops at ``most`` times its own
words, and what it cannot take is shared again by weight until no source is above (water filling).

Each source is a circle of ``BLOCKS`` hash blocks, in the order of a seeded hash: a permutation of its
documents. It is passed over floor(target / words) times and then up to the block where the rest of its
target is reached, within which whole documents, then the first words of one, fill the quota. So every
source has an exact quota of blocks. A tree splits the quotas of all sources among the output shards:
each node draws the left half's blocks from a multivariate hypergeometric distribution, seeded by the
node's place, so shards get disjoint runs of the permuted blocks of each source in random proportions.
In a shard, copies are shuffled by a hash.

Only sums per source (sources are metadata: at most ``MAX_SOURCES``) reach the driver; sums per block
stay distributed, and only documents of the one split block of a source are ordered one by one.

Edge cases: null or blank texts have size 0 and nothing is taken of them; documents without source form
one, last in order; rows repeating a doc_id are documents of their own; other columns are ignored; if
there is no word at all, nothing is taken; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

WEIGHTS = (5.0, 2.0, 1.0)
BLOCKS = 1024
FINE = 1024
SHARDS = 64
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[float], weights: list[float], most: float) -> list[float]:
    """Water filling: shares of the total by weight, none above ``most`` times its size."""
    total = float(sum(sizes))
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        by = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / by >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / by
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards x sources) block quotas: a tree of multivariate hypergeometric draws."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(q: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = q
            return
        middle = (first + last) // 2
        total = int(q.sum())
        draw = round(total * (middle - first) / (last - first))
        left = np.random.default_rng([seed, first, last]).multivariate_hypergeometric(q, draw, method="marginals") if total else q * 0
        down(left, first, middle)
        down(q - left, middle, last)

    down(np.asarray(quotas, np.int64), 0, shards)
    return out


@dataclass(frozen=True)
class Mix:
    #: every document: (_row, id, source, size, source_size, target, taken, h)
    documents: DataFrame
    #: (source, bounds): the first block of the source's run that each shard gets
    shards: DataFrame


def _rows(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, key_col: str | None) -> DataFrame:
    text = F.col(text_col).cast("string")
    # rows that repeat an id differ by their text; equal rows are told apart by nothing, and need not be
    return df.select(*([F.col(key_col).alias("key")] if key_col else []), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, key_col: str | None = None) -> DataFrame:
    """(row, id, source, size, source_size, target, taken, h, block[, key]) of every document, as a written table.

    row is a number of its own; key is the caller's, if ``key_col`` names a column that tells rows apart.
    """
    spark = df.sparkSession
    key = ["key"] if key_col else []
    rows = materialize(_rows(df, id_col, text_col, source_col, seed, key_col).withColumn("block", F.pmod("h", F.lit(BLOCKS)).cast("int")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # code point order is the order of the UTF-8 bytes
    sums = sorted(sums, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    want = targets([r["s"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], most)
    plan = []
    for r, t in zip(sums, want, strict=True):
        words = min(round(t), int(most * r["s"]))
        passes, rest = divmod(words, r["s"]) if r["s"] else (0, 0)
        plan.append((r["source"], int(r["s"]), float(t), int(passes), int(rest)))
    plan = small(spark.createDataFrame(plan, "source string, source_size long, target double, passes long, rest long"))
    rows = rows.withColumn("fine", F.pmod(F.floor(F.col("h") / BLOCKS), F.lit(FINE)).cast("int"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    # the block, then the part of it, in which the rest of the target is reached
    def cut(parts: DataFrame, key: str, need: DataFrame, name: str) -> DataFrame:
        sums = parts.groupBy("source", key).agg(F.sum("size").alias("s"))
        run = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy(key)) - F.col("s"))
        both = run.join(need, same(run, need)).select(run["source"], F.col(key).alias(name), F.col("rest") - F.col("before") if name == "cut" else (F.col("over") - F.col("before")), "s")
        both = both.toDF("source", name, "over_", "s")
        return both.where("over_ >= 0 and over_ < s").select("source", name, F.col("over_").alias("over" if name == "cut" else "last"))

    first = materialize(cut(rows, "block", plan, "cut"), "cut")
    second_rows = rows.join(F.broadcast(first), rows["source"].eqNullSafe(first["source"]) & (rows["block"] == first["cut"]), "left_semi")
    second = materialize(cut(second_rows, "fine", first, "cut_fine"), "cut")
    planned = rows.join(plan, same(rows, plan), "left").select(rows["*"], "source_size", "target", "passes")
    both = first.join(second, same(first, second)).select(first["source"].alias("source"), "cut", "cut_fine", "last")
    at = planned.join(small(both), planned["source"].eqNullSafe(both["source"]), "left").select(planned["*"], "cut", "cut_fine", "last")
    inside = (F.col("block") == F.col("cut")) & (F.col("fine") == F.col("cut_fine"))
    whole = (F.col("block") < F.col("cut")) | ((F.col("block") == F.col("cut")) & (F.col("fine") < F.col("cut_fine")))
    edge = at.where(inside)
    edge = edge.withColumn("before", F.sum("size").over(Window.partitionBy("source").orderBy("h", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    edge = edge.withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("last") - F.col("before")))).drop("before")
    rest = at.where(~F.coalesce(inside, F.lit(False))).withColumn("more", F.when(whole, F.col("size")).otherwise(F.lit(0)))
    out = rest.unionByName(edge).withColumn("taken", (F.col("size") * F.col("passes") + F.col("more")).cast("long"))
    return materialize(out.select("row", "id", "source", "size", "source_size", "target", "taken", "h", "block", *key), "mixed")


def shards(mixed: DataFrame, count: int = SHARDS, seed: int = 17) -> DataFrame:
    """(source, shard, first, last): the runs of drawn blocks, pass after pass, that each shard gets of each source."""
    spark = mixed.sparkSession
    quota = mixed.groupBy("source").agg(F.max(F.when(F.col("size") > 0, F.floor((F.col("taken") - 1) / F.col("size")) * BLOCKS + F.col("block") + 1).otherwise(0)).alias("q")).collect()
    quota = sorted(quota, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    drawn = split_quotas(np.array([max(0, r["q"]) for r in quota]), count, seed)
    ends = np.cumsum(drawn, axis=0)
    rows = [(r["source"], s, int(ends[s, i] - drawn[s, i]), int(ends[s, i])) for i, r in enumerate(quota) for s in range(count) if drawn[s, i]]
    return spark.createDataFrame(rows, "source string, shard int, first long, last long")


def copies(mixed: DataFrame, count: int = SHARDS, seed: int = 17) -> DataFrame:
    """(row, id, source, copy, words, shard, place, h[, key]): every copy that is taken, its shard and its place's hash there."""
    runs = small(shards(mixed, count, seed))
    n = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    each = mixed.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    each = each.withColumn("words", F.least("size", F.col("taken") - F.col("copy") * F.col("size"))).withColumn("at", F.col("copy") * BLOCKS + F.col("block"))
    to = each["source"].eqNullSafe(runs["source"]) & (each["at"] >= runs["first"]) & (each["at"] < runs["last"])
    return each.join(runs, to).select("row", "id", each["source"], "copy", "words", "shard", F.xxhash64(F.lit(seed + 1), "h", "copy").alias("place"), "h", *(c for c in ("key",) if c in mixed.columns))


def dealt(mixed: DataFrame, count: int = SHARDS, seed: int = 17) -> DataFrame:
    """The documents of a mix, with ``taken`` summed over the copies that the shards draw."""
    drawn = copies(mixed, count, seed).groupBy("row").agg(F.sum("words").alias("drawn"))
    out = mixed.join(drawn, "row", "left").withColumn("taken", F.coalesce("drawn", F.lit(0)).cast("long"))
    return out.select(*mixed.columns)
