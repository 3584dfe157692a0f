"""Document mode: each row holds one JSON document.

A kernel in Python (Arrow batches of bounded bytes) parses a document once and gives the candidate renderings; pricing,
the do-no-harm gate, the choice, statistics and the archive are columns in the JVM, without a shuffle.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as L
from ..batches import small_batches
from ..kernel import archive, encode, parse

#: Documents of an Arrow batch, if they are short; its bytes are bounded besides.
ROWS = 5000
ERROR = "struct<code:string,byte_offset:bigint,size:bigint,depth:bigint,limit:bigint,msg:string>"
_ERROR = [pa.field("code", pa.string()), *[pa.field(x, pa.int64()) for x in ("byte_offset", "size", "depth", "limit")], pa.field("msg", pa.string())]


@dataclass(frozen=True)
class Config:
    """Knobs of a pass: profile (conservative, balanced, aggressive), limits, price and margin."""

    profile: str = "balanced"
    max_input_bytes: int = parse.MAX_BYTES
    max_depth: int = parse.MAX_DEPTH
    estimator: L.Estimator = L.HEURISTIC
    min_saving_bps: int | None = None

    @property
    def margin(self) -> int:
        own = self.estimator.over_claim_bps if self.min_saving_bps is None else self.min_saving_bps
        return min(max(own, 0), 10_000)


def _uncollected(f: Callable) -> Callable:
    """``f`` on a batch without searches for cycles: a document is very many small objects, none of them in a cycle."""

    @functools.wraps(f)
    def run(content: pa.Array) -> pa.Array:
        on = gc.isenabled()
        gc.disable()
        try:
            return f(content)
        finally:
            if on:
                gc.enable()

    return run


def _read(content: pa.Array, config: Config):
    """For each document what was read, with whether it is JSON Lines, or why it is refused; None for a null."""
    max_bytes, max_depth = config.max_input_bytes, config.max_depth
    for c in content.to_numpy(zero_copy_only=False).tolist():  # far quicker than to_pylist()
        if c is None:
            yield None
            continue
        try:
            yield parse.read(parse.decode(c, max_bytes), max_depth)
        except parse.Rejected as e:
            yield e.with_traceback(None)  # which would hold the text


def _errors(found: list[parse.Rejected | None]) -> pa.StructArray:
    of = lambda name: [None if e is None else getattr(e, name) for e in found]
    columns = [pa.array(of("message" if f.name == "msg" else f.name), f.type) for f in _ERROR]
    return pa.StructArray.from_arrays(columns, fields=_ERROR, mask=pa.array([e is None for e in found], pa.bool_()))


# The functions on documents are dear. Spark runs one twice, or once a field, where a filter or a select names what it gives;
# those that may give other results each time are run once, so they are declared as such, though they do not.


def _analyser(config: Config):
    profile, price = config.profile, config.estimator.scalar

    @F.arrow_udf(f"struct<error:{ERROR},records:boolean,candidates:array<struct<id:int,rendering:string>>>")
    @_uncollected
    def analyse(content: pa.Array) -> pa.Array:
        errors, records, ends, ids, renderings = [], [], [], [], []
        for found in _read(content, config):
            refused = isinstance(found, parse.Rejected)
            errors.append(found if refused else None)
            records.append(None if found is None else False if refused else found[1])
            ends.append(None if found is None else len(ids))
            if found is not None and not refused:
                for i, r in encode.candidates(*found, profile, price):
                    ids.append(i)
                    renderings.append(r)
        items = pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(renderings, pa.string())], names=["id", "rendering"])
        lists = pa.ListArray.from_arrays(pa.array([*ends, len(ids)], pa.int32()), items)
        return pa.StructArray.from_arrays([_errors(errors), pa.array(records, pa.bool_()), lists], names=["error", "records", "candidates"])

    return analyse.asNondeterministic()


def _renderer(config: Config, encoder: int):
    profile, price = config.profile, config.estimator.scalar

    @F.arrow_udf("string")
    @_uncollected
    def render(content: pa.Array) -> pa.Array:
        out = []
        for found in _read(content, config):
            made = encode.candidates(*found, profile, price, encoder) if isinstance(found, tuple) else ()
            out.append(made[0][1] if made else None)
        return pa.array(out, pa.string())

    return render.asNondeterministic()


def _validator(config: Config):
    @F.arrow_udf(ERROR)
    @_uncollected
    def check(content: pa.Array) -> pa.Array:
        return _errors([found if isinstance(found, parse.Rejected) else None for found in _read(content, config)])

    return check.asNondeterministic()


def compress(df: DataFrame, content: str, config: Config = Config(), out: str = "artifact") -> DataFrame:
    """Add ``out``: struct(error, rendering, archive, stats). Of a refused document only the error is set; null gives null.

    ``content`` is a binary or string column. Equal bytes and config give equal results on any cluster.
    """
    small_batches(df.sparkSession, ROWS)
    body = F.col(content).cast("binary")
    price = config.estimator.column
    step = df.withColumn("_analysed", _analyser(config)(body))
    text = F.col(content).cast("string")
    priced = F.transform(F.col("_analysed.candidates"), lambda c: F.struct(price(c["rendering"]).alias("tokens"), c["id"].alias("id"), c["rendering"].alias("rendering")))
    if config.estimator not in (L.HEURISTIC, L.BYTES):
        # a Python price cannot run inside a lambda: one column for each place of the list
        size = max(len(x) for x in (encode.PROFILES[config.profile], encode.RECORD_PROFILES[config.profile]))
        one = [F.get(F.col("_analysed.candidates"), i) for i in range(size)]
        priced = F.filter(F.array(*[F.when(c.isNotNull(), F.struct(price(c["rendering"]).cast("long").alias("tokens"), c["id"].alias("id"), c["rendering"].alias("rendering"))) for c in one]), lambda c: c.isNotNull())
    ok = F.col("_analysed").isNotNull() & F.col("_analysed.error").isNull() & F.col("_analysed.records").isNotNull()
    step = step.withColumn("_before", F.when(ok, price(text))).withColumn("_priced", priced)
    fits = lambda c: L.clears_margin(c["tokens"], F.col("_before"), F.lit(config.margin))
    step = step.withColumn("_best", F.array_min(F.filter("_priced", fits))).withColumn("_refused", F.exists("_priced", lambda c: ~fits(c)))
    size = F.octet_length(body).cast("long")
    after = F.when(F.col("_best").isNull(), size).otherwise(F.octet_length("_best.rendering").cast("long"))
    tokens = F.coalesce("_best.tokens", "_before")
    stats = F.struct(
        size.alias("bytes_before"),
        after.alias("bytes_after"),
        F.col("_before").alias("est_tokens_before"),
        tokens.alias("est_tokens_after"),
        F.coalesce("_best.id", F.lit(0)).alias("encoder"),
        F.lit(config.estimator.id).alias("tokenizer_id"),
        F.lit(config.margin).alias("min_saving_bps"),
        F.col("_refused").alias("gate_rejected_candidate"),
        F.lit("lossless").alias("fidelity"),
        L.ratio(after, size).alias("byte_ratio"),
        L.ratio(tokens, F.col("_before")).alias("token_ratio"),
    )
    artifact = F.struct(F.col("_analysed.error").alias("error"), F.when(ok, F.coalesce("_best.rendering", text)).alias("rendering"), F.when(ok, L.archive(body)).alias("archive"), F.when(ok, stats).alias("stats"))
    return step.withColumn(out, F.when(F.col(content).isNotNull(), artifact)).drop("_analysed", "_before", "_priced", "_best", "_refused")


def exact_counts(df: DataFrame, content: str, counter: L.Estimator, artifact: str = "artifact", out: str = "exact") -> DataFrame:
    """Add ``out``: struct(before, after, ratio, tokenizer_id) by a second price of what a pass took in and gave; null for a refused document."""
    a = F.col(artifact)
    before = counter.column(F.col(content).cast("string")).cast("long")
    after = F.when(a["stats"]["encoder"] == 0, before).otherwise(counter.column(a["rendering"]).cast("long"))
    counts = F.struct(before.alias("before"), after.alias("after"), L.ratio(after, before).alias("ratio"), F.lit(counter.id).alias("tokenizer_id"))
    return df.withColumn(out, F.when(a["stats"].isNotNull(), counts))


def rendering(df: DataFrame, content: str, encoder: int, config: Config = Config("aggressive"), out: str = "rendering") -> DataFrame:
    """Add ``out``: what one encoder makes of each document, whatever it costs; null if it declines or the document is refused."""
    small_batches(df.sparkSession, ROWS)
    return df.withColumn(out, _renderer(config, encoder)(F.col(content).cast("binary")))


def estimate(df: DataFrame, content: str, config: Config = Config(), out: str = "stats") -> DataFrame:
    """The statistics of a pass without its renderings."""
    done = compress(df, content, config, "_artifact")
    return done.withColumn(out, F.col("_artifact.stats")).withColumn("error", F.col("_artifact.error")).drop("_artifact")


def _unpacker():
    kind = T.StructType([T.StructField("original", T.BinaryType()), T.StructField("code", T.StringType()), T.StructField("byte_offset", T.LongType())])

    @F.pandas_udf(kind)
    def unpack(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for b in blobs:
            if b is None:
                rows.append((None, None, None))
                continue
            try:
                rows.append((archive.unpack(bytes(b)), None, None))
            except archive.Damaged as e:
                rows.append((None, e.code, e.byte_offset))
        return pd.DataFrame({"original": pd.Series([r[0] for r in rows], dtype=object), "code": pd.Series([r[1] for r in rows], dtype=object), "byte_offset": pd.array([r[2] for r in rows], dtype="Int64")})

    return unpack


def decompress(df: DataFrame, blob: str, out: str = "recovered") -> DataFrame:
    """Add ``out``: struct(original, code, byte_offset); fail-closed, original is set only if every check holds."""
    small_batches(df.sparkSession, ROWS)
    return df.withColumn(out, _unpacker()(F.col(blob)))


def _shredder(max_bytes: int, max_depth: int):
    def run(batches):
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for key, content in zip(keys, batch.column(1).to_pylist(), strict=True):
                if content is None:
                    continue
                try:
                    doc, _ = parse.read(parse.decode(content, max_bytes), max_depth)
                except parse.Rejected:
                    continue
                out += [(key, *row) for row in parse.nodes(doc)]
                if len(out) > 20_000:
                    yield _nodes(out, batch.schema.field(0).type)
                    out = []
            if out:
                yield _nodes(out, batch.schema.field(0).type)

    return run


def _nodes(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "idx", "kind", "start", "end", "depth", "n", "b"])


def shred(df: DataFrame, key: str, content: str, config: Config = Config()) -> DataFrame:
    """The node relation of every accepted document: (doc_id, idx, kind, start, end, depth, n, b), byte offsets.

    JSON Lines are shredded as the array of their records."""
    small_batches(df.sparkSession, ROWS)
    rows = df.select(F.col(key).alias("doc_id"), F.col(content).cast("binary").alias("content"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_shredder(config.max_input_bytes, config.max_depth), f"doc_id {kind}, idx long, kind string, start long, end long, depth long, n long, b boolean")


def validate(content: Column, config: Config = Config()) -> Column:
    """The error of each document, null if it is accepted; guards come before the parser."""
    small_batches(SparkSession.active(), ROWS)
    return _validator(config)(content.cast("binary"))
