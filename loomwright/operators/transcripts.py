"""The transcript job: what tool results cost over a conversation, and what re-encoding them would save.

Lines become events (requests, boundaries, tool uses, tool results); all that follows is windows and
aggregates. A file is one conversation; windows are partitioned by it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as L
from ..kernel import parse, protocol
from .compress import Config, compress

UNKNOWN = "(unknown)"
HOOK_PREFIX = "mcp__"
# Fixed prices relative to an input token.
INPUT, WRITE_5M, WRITE_1H, READ, OUTPUT = 1.0, 1.25, 2.0, 0.10, 5.0
_USAGE = pa.struct([(k, pa.int64()) for k in ("input", "output", "cache_read", "write_1h", "write_5m")])
SCHEMA = "file string, line_no long, block_no int, kind string, request_id string, tool_use_id string, tool_name string, text string, usage struct<input:long,output:long,cache_read:long,write_1h:long,write_5m:long>"


def _usage(u: dict) -> dict:
    count = protocol.count_field
    split = u.get("cache_creation")
    created = count(u, "cache_creation_input_tokens")
    hour, five = (count(split, "ephemeral_1h_input_tokens"), count(split, "ephemeral_5m_input_tokens")) if isinstance(split, dict) else (0, created)
    return {"input": count(u, "input_tokens"), "output": count(u, "output_tokens"), "cache_read": count(u, "cache_read_input_tokens"), "write_1h": hour, "write_5m": five}


def line_events(line: bytes) -> list[tuple]:
    """(block_no, kind, request_id, tool_use_id, tool_name, text, usage) of one line; kinds also count: record, sidechain, unparsed."""
    event = lambda block, kind, request=None, use=None, name=None, text=None, usage=None: (block, kind, request, use, name, text, usage)
    try:
        text = line.decode("utf-8").strip(" \t\n\f\r")
        if not text:
            return []
        record = protocol.loads(text)
        if not isinstance(record, dict):
            return [event(-1, "unparsed")]
    except (UnicodeDecodeError, parse.Rejected):
        return [event(-1, "unparsed")]
    if protocol.truthy(record.get("isSidechain")):
        return [event(-1, "sidechain")]
    out = [event(-1, "record")]
    if protocol.truthy(record.get("isCompactSummary")) or record.get("subtype") == "compact_boundary" or protocol.truthy(record.get("compactMetadata")):
        return [*out, event(0, "boundary")]
    message = record.get("message")
    if not isinstance(message, dict):
        return out
    if record.get("type") == "assistant" and isinstance(message.get("usage"), dict):
        request = protocol.text_field(record, "requestId") or protocol.text_field(message, "id")
        if request:
            out.append(event(0, "request", request, usage=_usage(message["usage"])))
    blocks = message.get("content")
    for n, block in enumerate(blocks if isinstance(blocks, list) else [], 1):
        if not isinstance(block, dict):
            continue
        if block.get("type") == "tool_use":
            use, name = protocol.text_field(block, "id"), protocol.text_field(block, "name")
            if use is not None and name is not None:
                out.append(event(n, "use", use=use, name=name))
        elif block.get("type") == "tool_result":
            body = block.get("content")
            if isinstance(body, list):
                body = "".join(p["text"] for p in body if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str))
            if isinstance(body, str) and body:
                out.append(event(n, "result", use=protocol.text_field(block, "tool_use_id"), text=body))
    return out


def _events(batches):
    for batch in batches:
        files, numbers, lines = (batch.column(i).to_pylist() for i in range(3))
        rows = [(f, n, *e) for f, n, line in zip(files, numbers, lines, strict=True) for e in line_events(line)]
        kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 5, _USAGE]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "line_no", "block_no", "kind", "request_id", "tool_use_id", "tool_name", "text", "usage"])


def events(lines: DataFrame) -> DataFrame:
    """Events of (path, line_no, line)."""
    return lines.select("path", "line_no", "line").mapInArrow(_events, SCHEMA)


def _position() -> list[str]:
    return ["line_no", "block_no"]


def named_results(ev: DataFrame) -> DataFrame:
    """Uses and results with ``tool``: the latest use of the id before a result names it (a backward as-of join)."""
    before = Window.partitionBy("file", "tool_use_id").orderBy(*_position()).rowsBetween(Window.unboundedPreceding, 0)
    name = F.last(F.when(F.col("kind") == "use", F.col("tool_name")), ignorenulls=True).over(before)
    some = ev.where(F.col("kind").isin("use", "result"))
    return some.withColumn("tool", F.when(F.col("tool_use_id").isNull(), F.lit(UNKNOWN)).otherwise(F.coalesce(name, F.lit(UNKNOWN))))


def sequence(ev: DataFrame) -> DataFrame:
    """Events with ``requests`` (distinct ones so far in the file), ``segment`` (boundaries so far) and ``compaction`` (a boundary that counts)."""
    by_file = Window.partitionBy("file").orderBy(*_position())
    so_far = by_file.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("file", "kind", "request_id").orderBy(*_position())) == 1
    some = ev.where(F.col("kind").isin("request", "boundary", "result", "use")).withColumn("new", (F.col("kind") == "request") & first)
    some = some.withColumn("requests", F.sum(F.col("new").cast("long")).over(so_far)).withColumn("segment", F.sum((F.col("kind") == "boundary").cast("long")).over(so_far))
    # boundaries in a row count once: only a new request or a result comes between
    mark = F.when((F.col("kind") == "boundary") | F.col("new") | (F.col("kind") == "result"), F.col("kind"))
    last = F.last(mark, ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    return some.withColumn("compaction", (F.col("kind") == "boundary") & ~F.coalesce(last == "boundary", F.lit(False)))


def later_requests(ev: DataFrame) -> DataFrame:
    """Results with ``later``: the new requests from there to the end of their segment."""
    seq = sequence(ev)
    # a boundary ends the segment before it and opens the next with the same count
    end = F.max("requests").over(Window.partitionBy("file", "segment"))
    return seq.withColumn("later", end - F.col("requests")).where("kind = 'result'")


def last_usage(ev: DataFrame) -> DataFrame:
    """One row a request id over all files: the usage of its last record, files in path order."""
    place = F.struct(F.split("file", "/"), "line_no")
    return ev.where("kind = 'request'").groupBy("request_id").agg(F.max_by("usage", place).alias("usage"))


def bill(ev: DataFrame) -> DataFrame:
    """(requests, input, write_5m, write_1h, cache_read, output, units, write_price) in one row."""
    u = last_usage(ev)
    total = u.agg(F.count("*").alias("requests"), *[F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).cast("long").alias(c) for c in ("input", "write_5m", "write_1h", "cache_read", "output")])
    units = F.col("input") * INPUT + F.col("write_5m") * WRITE_5M + F.col("write_1h") * WRITE_1H + F.col("cache_read") * READ + F.col("output") * OUTPUT
    written = F.col("input") + F.col("write_5m") + F.col("write_1h")
    price = (F.col("input") * INPUT + F.col("write_5m") * WRITE_5M + F.col("write_1h") * WRITE_1H) / F.when(written > 0, written)
    return total.withColumn("units", units).withColumn("write_price", price)


def measured_results(ev: DataFrame, config: Config = Config()) -> DataFrame:
    """(file, tool, before, after, later): prices of each result and of what would replace it (null: nothing)."""
    names = named_results(ev).where("kind = 'result'").select("file", "line_no", "block_no", "tool")
    rows = later_requests(ev).select("file", "line_no", "block_no", "text", "later").join(names, ["file", "line_no", "block_no"])
    done = compress(rows, "text", config)
    price = config.estimator.column
    better = (F.col("artifact.stats.encoder") != 0) & (F.octet_length("artifact.rendering") < F.octet_length("text"))
    return done.select("file", "tool", price(F.col("text")).alias("before"), F.when(better, price(F.col("artifact.rendering"))).alias("after"), "later")


def _tokens(c: Column, prefix: str) -> list[Column]:
    n = F.col("later")
    part = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(f"{prefix}_{name}")
    return [part(c, "total"), part(F.when(n > 0, c), "written"), part(F.when(n > 0, c * (n - 1)), "reread"), part(c * n, "turns")]


def tool_report(results: DataFrame) -> DataFrame:
    """Rows by tool, of all tools (tool null, scope all) and of the hooked ones (scope hook), dearest first.

    Results are summed up once by tool; the two subtotals are sums of these rows.
    """
    after = F.coalesce("after", "before")
    sums = [F.count("*").alias("results"), F.count("after").alias("replaced"), *_tokens(F.col("before"), "before"), *_tokens(after, "after")]
    by_tool = results.groupBy("tool").agg(*sums)
    names = [c for c in by_tool.columns if c != "tool"]
    scope = lambda name, tool: F.struct(F.lit(name).alias("scope"), tool.alias("tool"))
    nobody = F.lit(None).cast("string")
    hooked = F.when(F.col("tool").startswith(HOOK_PREFIX), scope("hook", nobody))
    each = by_tool.select(F.explode(F.array_compact(F.array(scope("tool", F.col("tool")), scope("all", nobody), hooked))).alias("s"), *names)
    # the subtotals of nothing are there too
    none = results.sparkSession.range(1).select(F.explode(F.array(scope("all", nobody), scope("hook", nobody))).alias("s"), *[F.lit(0).cast("long").alias(c) for c in names])
    total = each.unionByName(none).groupBy("s").agg(*[F.sum(c).alias(c) for c in names])
    return total.select("s.scope", "s.tool", *names).orderBy(F.desc("before_total"), "scope", "tool")


def shares(report: DataFrame, billed: DataFrame) -> DataFrame:
    """(mean_later, tool_share, saving_share, hook_share): parts of the bill; null where there is none."""
    # one row with the two subtotals, so the report is made once
    of = lambda scope, c: F.max(F.when(F.col("scope") == scope, F.col(c))).alias(f"{scope}_{c}")
    row = report.agg(*[of(s, c) for s in ("all", "hook") for c in report.columns if c not in ("scope", "tool", "results", "replaced")])
    cost = lambda p: F.col(f"{p}_written") * F.col("write_price") + F.col(f"{p}_reread") * READ
    units = F.when(F.col("units") > 0, F.col("units"))
    saved = lambda s: (cost(f"{s}_before") - cost(f"{s}_after")) / units
    return row.join(F.broadcast(billed)).select(
        F.try_divide(F.col("all_before_turns"), F.col("all_before_total")).alias("mean_later"), (cost("all_before") / units).alias("tool_share"), saved("all").alias("saving_share"), saved("hook").alias("hook_share")
    )


def escaped(name: str) -> str:
    """An untrusted name for a terminal: quotes, the backslash and all that is not printable are written as escapes."""
    short = {"\t": "\\t", "\r": "\\r", "\n": "\\n", "\0": "\\0", "'": "\\'", '"': '\\"', "\\": "\\\\"}
    return "".join(short.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in name)


def report_table(rows: list, price: str = "heuristic") -> str:
    """The collected report as an aligned table for a reader: one line a tool, then the subtotals."""
    scopes = {"all": "all tools", "hook": f"{HOOK_PREFIX}* (hooked)"}
    lines = [("tool", "results", "tokens before", "tokens after", "ratio", "replaced")]
    for r in sorted(rows, key=lambda r: r["scope"] in scopes):
        ratio = r["after_total"] / r["before_total"] if r["before_total"] else 1.0
        lines.append((scopes.get(r["scope"]) or escaped(r["tool"]), *map(str, (r["results"], r["before_total"], r["after_total"])), f"{ratio:.3f}", str(r["replaced"])))
    wide = [max(len(line[k]) for line in lines) for k in range(6)]
    body = ["  ".join([line[0].ljust(wide[0]), *(cell.rjust(w) for cell, w in zip(line[1:], wide[1:], strict=True))]) for line in lines]
    return f"tool results, counted with {price}:\n" + "\n".join(body) + "\n"


def counters(ev: DataFrame) -> DataFrame:
    """(files, records, sidechain, unparsed, compactions)."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}s" if k == "record" else k)
    a = ev.agg(F.count_distinct("file").alias("files"), n("record"), n("sidechain"), n("unparsed"))
    return a.join(F.broadcast(sequence(ev).agg(F.count_if("compaction").alias("compactions"))))


def hook_replaces(df: DataFrame, text: str, config: Config = Config(), counter: L.Estimator | None = None) -> DataFrame:
    """Whether a tool result would be replaced by its rendering: accepted, re-encoded and cheaper, in bytes or by an exact counter."""
    done = compress(df, text, config)
    size = F.octet_length if counter is None else counter.column
    ok = F.col("artifact.error").isNull() & (F.col("artifact.stats.encoder") != 0) & (size(F.col("artifact.rendering")) < size(F.col(text)))
    return done.withColumn("replace", F.coalesce(ok, F.lit(False)))


def report_line(report: DataFrame, billed: DataFrame) -> DataFrame:
    """The whole report as one JSON line."""
    rows = report.agg(F.sort_array(F.collect_list(F.struct(F.col("scope"), F.col("tool"), *[c for c in report.columns if c not in ("scope", "tool")]))).alias("tools"))
    return rows.join(F.broadcast(billed)).select(F.to_json(F.struct("tools", F.struct(*billed.columns).alias("bill")), {"ignoreNullFields": "false"}).alias("line"))


def percent_text(share: Column) -> Column:
    return L.percent(share)
