"""One query for each operator of the engine over the tables of the driver; each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as L
from ..operators import Config, compress, comprehension, decompress, grid_text, shred, table_text, tables, transcripts
from ..operators.compress import rendering, validate
from ..streaming import rpc

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _tokens(c: str) -> str:
    """The heuristic estimate in DuckDB's SQL."""
    return (
        f"(coalesce(list_sum(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda x: (length(x) * 10 + 36) // 37)), 0)"
        f" + len(regexp_extract_all({c}, '[ \\t\\n\\f\\r]{{2,}}'))"
        f" + len(regexp_extract_all({c}, '[\\x00-\\x08\\x0B\\x0E-\\x1F!-/:-@\\[-`{{-\\x7F]'))"
        f" + coalesce(list_sum(list_transform(regexp_extract_all({c}, '[^\\x00-\\x7F]+'), lambda x: (strlen(x) + 1) // 2)), 0))::bigint"
    )


def _low(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _protected_sql(c: str, what: int) -> str:
    from ..kernel.price import RULES, lower

    whens = " ".join(f"WHEN contains({c if exact else _low(c)}, '{literal if exact else lower(literal)}') THEN '{(name, literal)[what]}'" for name, literal, exact in RULES)
    return f"CASE {whens} END"


# --- flagship: orders of each customer as documents, re-encoded ---


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").withColumn("o_date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return tables.documents_of(orders, ["o_custkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_date"], ["o_orderkey"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as JSON documents, re-encoded: by encoder the documents, bytes and tokens before and after."""
    done = compress(_order_documents(spark, sf_dir), "content", Config("aggressive"))
    s = F.col("artifact.stats")
    return done.groupBy(s["encoder"].alias("encoder")).agg(F.count("*").alias("documents"), F.sum(s["bytes_before"]).alias("bytes_before"), F.sum(s["bytes_after"]).alias("bytes_after"), F.sum(s["est_tokens_before"]).alias("tokens_before"), F.sum(s["est_tokens_after"]).alias("tokens_after"))


@_query()
def compress_orders_by_customer(spark, sf_dir):
    return flagship(spark, sf_dir)


# --- prices ---


@_query(f"SELECT doc_id, {_tokens('text')} AS tokens, strlen(text)::bigint AS bytes FROM documents")
def est_tokens_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", L.heuristic_tokens(F.col("text")).alias("tokens"), L.byte_tokens(F.col("text")).alias("bytes"))


@_query(f"SELECT page_id, {_tokens('html')} AS tokens FROM pages")
def est_tokens_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", L.heuristic_tokens(F.col("html")).alias("tokens"))


@_query(f"SELECT conv_id, turn, {_tokens('text')} AS tokens FROM conversations")
def est_tokens_conversations(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", L.heuristic_tokens(F.col("text")).alias("tokens"))


@_query(f"SELECT lang, source, count(*) AS n, sum({_tokens('text')})::bigint AS tokens, sum(strlen(text))::bigint AS bytes FROM documents GROUP BY lang, source")
def est_by_lang_source(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(L.heuristic_tokens(F.col("text"))).alias("tokens"), F.sum(L.byte_tokens(F.col("text"))).alias("bytes"))


# --- protected literals ---


@_query(f"SELECT doc_id, {_protected_sql('text', 0)} AS class, {_protected_sql('text', 1)} AS literal FROM documents")
def protected_class_documents(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").withColumn("p", L.protected(F.col("text")))
    return d.select("doc_id", "p.class", "p.literal")


@_query(f"SELECT coalesce({_protected_sql('html', 0)}, 'none') AS class, count(*) AS n FROM pages GROUP BY 1")
def protected_class_pages(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.groupBy(F.coalesce(L.protected(F.col("html"))["class"], F.lit("none")).alias("class")).agg(F.count("*").alias("n"))


@_query("SELECT * FROM (VALUES ('authz', 2), ('certificate', 10), ('compiler', 3), ('denial', 1), ('errno', 3), ('http-status', 15), ('panic', 2), ('stack-trace', 3), ('warning', 1)) t(class, n)")
def protected_rules_by_class(spark, sf_dir):
    return L.protected_rules(spark).groupBy("class").agg(F.count("*").cast("int").alias("n"))


# --- parsing, minifying, selecting, archiving ---


@_query(
    "SELECT event_id, idx, kind, s AS \"start\", e AS \"end\", depth, n::bigint AS n, NULL::boolean AS b FROM (SELECT event_id, strlen(props) AS z FROM events), "
    "LATERAL (VALUES (0, 'ObjectStart', 0, 1, 0, 1), (1, 'Key', 1, 4, 1, NULL), (2, 'Number', 6, z - 1, 1, NULL), (3, 'ObjectEnd', z - 1, z, 0, NULL)) t(idx, kind, s, e, depth, n)"
)
def shred_props(spark, sf_dir):
    nodes = shred(_table(spark, sf_dir, "events"), "event_id", "props")
    return nodes.withColumnRenamed("doc_id", "event_id")


@_query("SELECT event_id, json(props)::varchar AS body, strlen(json(props)::varchar) / strlen(props) AS byte_ratio FROM events")
def minify_props(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    body = L.minify_plain(F.col("props"))
    return e.select("event_id", body.alias("body"), L.ratio(F.octet_length(body), F.octet_length("props")).alias("byte_ratio"))


_FRAMED = "('#tkfd1 min' || chr(10) || json(props)::varchar)"


@_query(
    f"SELECT event_id, CASE WHEN a < b THEN 1 ELSE 0 END AS encoder, b AS tokens_before, least(a, b) AS tokens_after, a >= b AS gate_rejected_candidate FROM (SELECT event_id, {_tokens('props')} AS b, {_tokens(_FRAMED)} AS a FROM events)"
)
def select_encoder_props(spark, sf_dir):
    done = compress(_table(spark, sf_dir, "events"), "props", Config("conservative"))
    s = F.col("artifact.stats")
    return done.select("event_id", s["encoder"].alias("encoder"), s["est_tokens_before"].alias("tokens_before"), s["est_tokens_after"].alias("tokens_after"), s["gate_rejected_candidate"].alias("gate_rejected_candidate"))


@_query("SELECT event_id, '544B464401000000000' || '0' || upper(printf('%02x', strlen(props))) || upper(sha256(props)) AS header FROM events")
def archive_header_props(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", L.archive_header_hex(F.col("props").cast("binary")).alias("header"))


@_query("SELECT count(*) AS n, count(*) AS same, 0::bigint AS refused FROM documents")
def archive_roundtrip_documents(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw")).withColumn("blob", L.archive(F.col("raw")))
    back = decompress(d, "blob")
    return back.agg(F.count("*").alias("n"), F.count_if(F.col("recovered.original") == F.col("raw")).alias("same"), F.count("recovered.code").alias("refused"))


@_query("SELECT doc_id, 'invalid_json' AS code FROM documents")
def rejected_documents(spark, sf_dir):
    """Prose is no JSON: every document is refused with a code."""
    done = compress(_table(spark, sf_dir, "documents"), "text")
    return done.where(F.col("artifact.error").isNotNull()).select("doc_id", F.col("artifact.error.code").alias("code"))


@_query("SELECT event_id, base64(encode(props)) AS b64, true AS same FROM events")
def base64_props(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "props", L.base64_text(F.col("props").cast("binary")).alias("b64"))
    return e.select("event_id", "b64", (L.base64_strict(F.col("b64")) == F.col("props").cast("binary")).alias("same"))


_LINE = "'{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"value\":' || value || '}'"
_RECORD = "'+[' || event_id || ',\"' || event_type || '\",' || value || ']' || chr(10)"


@_query(
    "SELECT user_id, CASE WHEN won THEN 4 ELSE 0 END AS encoder, strlen(content) AS bytes_before, strlen(CASE WHEN won THEN rendering ELSE content END) AS bytes_after, CASE WHEN won THEN a ELSE b END AS tokens_after FROM "
    f"(SELECT *, n > 1 AND a < b AS won FROM (SELECT *, {_tokens('content')} AS b, {_tokens('rendering')} AS a FROM (SELECT user_id, count(*) AS n, string_agg({_LINE}, chr(10) ORDER BY event_id) AS content, "
    f"'#tkfd1 jsonl' || chr(10) || chr(10) || '#' || count(*) || '[\"event_id\",\"event_type\",\"value\"]' || chr(10) || string_agg({_RECORD}, '' ORDER BY event_id) AS rendering FROM events GROUP BY user_id)))"
)
def jsonl_events_by_user(spark, sf_dir):
    """Each user's events as JSON Lines, re-encoded as records."""
    e = _table(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    docs = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("t")))), lambda r: r["t"]), "\n").alias("content"))
    s = F.col("artifact.stats")
    return compress(docs, "content").select("user_id", s["encoder"].alias("encoder"), s["bytes_before"].alias("bytes_before"), s["bytes_after"].alias("bytes_after"), s["est_tokens_after"].alias("tokens_after"))


@_query()
def refs_orders_by_customer(spark, sf_dir):
    done = compress(_order_documents(spark, sf_dir), "content", Config("aggressive", min_saving_bps=600))
    return done.select("o_custkey", "artifact.stats.encoder", "artifact.stats.est_tokens_after", F.md5("artifact.rendering").alias("rendering"))


# --- relation mode ---

_HEAD = "'{c}' || CASE WHEN count({x}) = count(*) AND min({x}) = max({x}) THEN '=' || min({x}) ELSE '' END"
_ORDER_CELLS = {"o_orderkey": "o_orderkey::varchar", "o_orderstatus": "'\"' || o_orderstatus || '\"'", "o_orderpriority": "'\"' || o_orderpriority || '\"'"}
_HEADER = " || ',' || ".join(_HEAD.format(c=c, x=x) for c, x in _ORDER_CELLS.items())
_CELLS = ", ".join(f"CASE WHEN v{i} THEN {x} END" for i, x in enumerate(_ORDER_CELLS.values()))
_VARIES = ", ".join(f"min({x}) OVER w <> max({x}) OVER w AS v{i}" for i, x in enumerate(_ORDER_CELLS.values()))


@_query(
    f"SELECT o_custkey, chr(10) || '#' || count(*) || '[' || {_HEADER} || ']' || chr(10) || string_agg('+' || concat_ws(',', {_CELLS}) || chr(10), '' ORDER BY o_orderkey) AS body "
    f"FROM (SELECT *, {_VARIES} FROM orders WINDOW w AS (PARTITION BY o_custkey)) GROUP BY o_custkey HAVING count(*) > 1"
)
def grid_orders_by_customer(spark, sf_dir):
    return grid_text(_table(spark, sf_dir, "orders"), ["o_custkey"], list(_ORDER_CELLS), ["o_orderkey"])


@_query(
    "SELECT o_custkey, chr(10) || '#' || count(*) || '[\"o_orderkey\",\"o_orderstatus\"]' || chr(10) || string_agg('+[' || o_orderkey || ',\"' || o_orderstatus || '\"]' || chr(10), '' ORDER BY o_orderkey) AS body FROM orders GROUP BY o_custkey HAVING count(*) > 1"
)
def table_orders_by_customer(spark, sf_dir):
    return table_text(_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], ["o_orderkey"])


@_query(
    "SELECT o_custkey, c AS \"column\", count(*) AS n, count(DISTINCT v) AS n_values, min(v) = max(v) AS constant FROM (SELECT o_custkey, unnest([{'c': 'o_orderstatus', 'v': o_orderstatus}, {'c': 'o_orderpriority', 'v': o_orderpriority}], recursive := true) FROM orders) GROUP BY o_custkey, c"
)
def constant_columns_orders(spark, sf_dir):
    return tables.constant_columns(_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@_query("SELECT shape, count(*) AS n, min(event_id) AS first_seen FROM (SELECT event_id, array_to_string(json_keys(props), ',') AS shape FROM events) GROUP BY shape")
def shape_counts_props(spark, sf_dir):
    nodes = shred(_table(spark, sf_dir, "events"), "event_id", "props").where("kind = 'Key'")
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").cast("binary").alias("raw"))
    key = F.expr("substring(raw, int(start) + 2, int(end - start) - 2)").cast("string")
    keys = nodes.join(e, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", key.alias("k")))).alias("ks"))
    return keys.groupBy(F.array_join(F.transform("ks", lambda x: x["k"]), ",").alias("shape")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_seen"))


@_query(f"SELECT l_returnflag, l_shipdate::date::varchar AS day, count(*) AS n, {_tokens(chr(39) + chr(34) + chr(39) + ' || l_shipdate::date::varchar || ' + chr(39) + chr(34) + chr(39))} AS cost FROM lineitem GROUP BY l_returnflag, l_shipdate::date::varchar")
def value_census_lineitem(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return tables.value_census(li, ["l_returnflag"], "day")


_RANKED = (
    f"(SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC, cost DESC, lexeme) AS rn FROM (SELECT l_returnflag, l_linestatus, lexeme, count(*) AS n, {_tokens('lexeme')} AS cost "
    "FROM (SELECT l_returnflag, l_linestatus, '\"' || l_shipdate::date::varchar || '\"' AS lexeme FROM lineitem) GROUP BY ALL HAVING count(*) > 1))"
)
#: An entry's reference is priced by the number of entries kept before it.
_PAYS = f"r.n * (r.cost - {_tokens(chr(39) + chr(34) + '$' + chr(39) + ' || k.kept || ' + chr(39) + chr(34) + chr(39))}) > r.cost + 1"


@_query(
    f"WITH RECURSIVE r AS {_RANKED}, k AS (SELECT DISTINCT l_returnflag, l_linestatus, 0::bigint AS rn, 0::bigint AS kept, false AS pays FROM r UNION ALL "
    f"SELECT r.l_returnflag, r.l_linestatus, r.rn, k.kept + CASE WHEN {_PAYS} THEN 1 ELSE 0 END, {_PAYS} FROM k JOIN r ON r.l_returnflag = k.l_returnflag AND r.l_linestatus = k.l_linestatus AND r.rn = k.rn + 1) "
    "SELECT l_returnflag, l_linestatus, (kept - 1)::integer AS place, lexeme, n, cost FROM k JOIN r USING (l_returnflag, l_linestatus, rn) WHERE pays"
)
def legend_entries_lineitem(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    census = tables.value_census(li, ["l_returnflag", "l_linestatus"], "day")
    made = tables.legend(census, ["l_returnflag", "l_linestatus"], "day")
    return made.select("l_returnflag", "l_linestatus", F.posexplode("legend").alias("place", "e")).select("l_returnflag", "l_linestatus", "place", "e.*")


_ID = "(event_id % 8 - 1)"


def _case(names: tuple[str, ...]) -> str:
    return f"CASE {_ID} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " ELSE 'unknown' END"


@_query(f"SELECT event_id, {_case(L.ENCODER_NAMES['report'])} AS encoder, {_case(L.ENCODER_NAMES['message'])} AS said, {_case(L.PRICE_NAMES)} AS price FROM events")
def names_of_ids(spark, sf_dir):
    number = F.col("event_id") % 8 - 1
    return _table(spark, sf_dir, "events").select("event_id", L.encoder_name(number).alias("encoder"), L.encoder_name(number, "message").alias("said"), L.price_name(number).alias("price"))


# --- nested and irregular documents, written out by SQL ---

_DAY = "o_orderdate::date::varchar"


def _nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as an array of nested objects, whose field at.by only finished orders have."""
    o = _table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    by = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(', "by" : "'), "o_orderpriority", F.lit('"'))).otherwise("")
    one = F.concat(F.lit('{ "id": '), F.col("o_orderkey").cast("string"), F.lit(', "at": {"day": "'), "day", F.lit('"'), by, F.lit('}, "list" : [ 1.50, {"x" : [ ]}, "a, b]" ] }'))
    docs = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("t")))).alias("rows"))
    return docs.select("o_custkey", F.concat(F.lit("[ "), F.array_join(F.transform("rows", lambda r: r["t"]), " ,\n"), F.lit(" ]")).alias("content"))


_BY = "CASE WHEN o_orderstatus = 'F' THEN '\"' || o_orderpriority || '\"' END"
_CELLS_OF = "SELECT o_custkey, o_orderkey, '\"' || {day} || '\"' AS day, {by} AS \"by\" FROM orders".format(day=_DAY, by=_BY)


@_query(
    "SELECT o_custkey, '#tkfd1 grid' || chr(10) || chr(10) || '#' || count(*) || '[id,at.day' || CASE WHEN any_value(one_day) THEN '=' || min(day) ELSE '' END || CASE WHEN any_value(any_by) THEN ',at.by' || CASE WHEN any_value(one_by) THEN '=' || min(\"by\") ELSE '' END ELSE '' END || ',list=[1.50,{\"x\":[]},\"a, b]\"]]' || chr(10) || "
    "string_agg('+' || o_orderkey || CASE WHEN one_day THEN '' ELSE ',' || day END || CASE WHEN any_by AND NOT one_by THEN ',' || coalesce(\"by\", '~') ELSE '' END || chr(10), '' ORDER BY o_orderkey) AS rendering FROM "
    f"(SELECT *, min(day) OVER w = max(day) OVER w AS one_day, count(\"by\") OVER w > 0 AS any_by, coalesce(count(\"by\") OVER w = count(*) OVER w AND min(\"by\") OVER w = max(\"by\") OVER w, false) AS one_by FROM ({_CELLS_OF}) WINDOW w AS (PARTITION BY o_custkey)) GROUP BY o_custkey HAVING count(*) > 1"
)
def grid_nested_orders(spark, sf_dir):
    return rendering(_nested_orders(spark, sf_dir), "content", 5).where("rendering is not null").select("o_custkey", "rendering")


@_query(
    f"SELECT o_custkey, count(*) * 19 + count(\"by\") * 2 + 2 AS nodes, count(*) * 5 + count(\"by\") AS keys, count(*) * 2 + count(\"by\") AS strings, count(*) * 2 AS numbers, 4 AS depth, count(*)::bigint AS entries, count(*) * 6 AS members FROM ({_CELLS_OF}) GROUP BY o_custkey"
)
def shred_nested_orders(spark, sf_dir):
    """What the node relation of nested documents holds: by kind, the depth, and the children that containers count."""
    nodes = shred(_nested_orders(spark, sf_dir), "o_custkey", "content")
    n = lambda kind: F.count_if(F.col("kind") == kind)
    sums = [F.count("*").alias("nodes"), n("Key").alias("keys"), n("String").alias("strings"), n("Number").alias("numbers"), F.max("depth").cast("int").alias("depth"), F.max(F.when(F.col("idx") == 0, F.col("n"))).alias("entries")]
    members = F.sum(F.when((F.col("kind") == "ObjectStart") & (F.col("depth") == 1) | (F.col("kind") == "ArrayStart") & (F.col("depth") == 2), F.col("n")))
    return nodes.groupBy(F.col("doc_id").alias("o_custkey")).agg(*sums, members.alias("members"))


@_query(
    "SELECT l_orderkey, l_linenumber, '#tkfd1 min' || chr(10) || '{\"k\":[' || l_orderkey || ',{\"q\":' || l_quantity::integer || '.00e+0,\"s\":\"A' || l_returnflag || 'é/\\\\\"}],\"e\":{},\"k\":[],\"t\":\"\\ud800\\u0041\"}' AS rendering FROM lineitem"
)
def minify_nested_lines(spark, sf_dir):
    """White space, escapes, repeated keys and lone surrogates: lexemes stay, escapes are undone where that is safe."""
    li = _table(spark, sf_dir, "lineitem")
    raw = F.concat(
        F.lit('{ "k" : [ '), F.col("l_orderkey").cast("string"), F.lit(' ,\t{ "q":'), F.col("l_quantity").cast("int").cast("string"), F.lit('.00e+0 , "s" : "\\u0041'), "l_returnflag", F.lit('\\u00e9\\/\\\\" } ] ,\n"e" : { } , "k":[ ], "t" : "\\ud800\\u0041" }\r\n')
    )
    return rendering(li.select("l_orderkey", "l_linenumber", raw.alias("content")), "content", 1).select("l_orderkey", "l_linenumber", "rendering")


_BROKEN = "CASE o_orderkey % 5 WHEN 0 THEN '{\"k\":' || o_orderkey WHEN 1 THEN '{\"k\" ' || o_orderkey || '}' WHEN 2 THEN '[' || o_orderkey || ',]' WHEN 3 THEN '[\"é\",' || o_orderkey || ' 7]' ELSE repeat('[', 600) || repeat(']', 600) END"


@_query(
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'depth_exceeded' ELSE 'invalid_json' END AS code, CASE o_orderkey % 5 WHEN 0 THEN strlen(t) WHEN 1 THEN 5 WHEN 2 THEN strlen(t) - 1 WHEN 3 THEN strlen(t) - 2 END::bigint AS byte_offset, CASE WHEN o_orderkey % 5 = 4 THEN 513 END::bigint AS depth FROM (SELECT o_orderkey, {_BROKEN} AS t FROM orders)"
)
def rejected_orders(spark, sf_dir):
    """Documents that are broken in five ways, with the place of the fault."""
    key = F.col("o_orderkey").cast("string")
    ways = [F.concat(F.lit('{"k":'), key), F.concat(F.lit('{"k" '), key, F.lit("}")), F.concat(F.lit("["), key, F.lit(",]")), F.concat(F.lit('["é",'), key, F.lit(" 7]")), F.lit("[" * 600 + "]" * 600)]
    done = _table(spark, sf_dir, "orders").select("o_orderkey", validate(F.array(*ways)[(F.col("o_orderkey") % 5).cast("int")]).alias("e"))
    return done.select("o_orderkey", "e.code", "e.byte_offset", "e.depth")


# --- transcripts: the event table read as tool events of one file a user ---

_KIND = "CASE event_type WHEN 'signup' THEN 'request' WHEN 'error' THEN 'boundary' WHEN 'view' THEN 'use' WHEN 'click' THEN 'result' ELSE 'other' END"
_EV = f"(SELECT user_id, event_id, {_KIND} AS kind, event_id % 7 AS use_id, event_id % 40 AS request_id, event_id % 3 AS tool, value FROM events)"
_SEQ = (
    f"(SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS requests, sum(CASE WHEN kind = 'boundary' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment "
    f"FROM (SELECT *, kind = 'request' AND row_number() OVER (PARTITION BY user_id, kind, request_id ORDER BY event_id) = 1 AS new FROM {_EV} WHERE kind <> 'other'))"
)


def _as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for x in ("signup", "request", "error", "boundary", "view", "use", "click", "result")])
    e = e.withColumn("kind", F.coalesce(F.try_element_at(kind, "event_type"), F.lit("other")))
    request, use, result = F.col("kind") == "request", F.col("kind") == "use", F.col("kind") == "result"
    usage = F.struct(F.col("user_id").alias("input"), (F.col("event_id") % 11).alias("output"), (F.col("event_id") % 101).alias("cache_read"), (F.col("event_id") % 5).alias("write_1h"), (F.col("event_id") % 3).alias("write_5m"))
    return e.select(
        F.col("user_id").cast("string").alias("file"),
        F.col("event_id").alias("line_no"),
        F.lit(0).alias("block_no"),
        "kind",
        F.when(request, (F.col("event_id") % 40).cast("string")).alias("request_id"),
        F.when(use | result, (F.col("event_id") % 7).cast("string")).alias("tool_use_id"),
        F.when(use, F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("mcp__")).otherwise(F.lit("t")), (F.col("event_id") % 3).cast("string"))).alias("tool_name"),
        F.when(result, F.col("props")).alias("text"),
        F.when(request, usage).alias("usage"),
    )


@_query(
    f"SELECT user_id::varchar AS file, event_id AS line_no, coalesce(last_value(CASE WHEN kind = 'use' THEN (CASE WHEN tool = 0 THEN 'mcp__' ELSE 't' END) || tool END IGNORE NULLS) OVER (PARTITION BY user_id, use_id ORDER BY event_id), '(unknown)') AS tool "
    f"FROM {_EV} WHERE kind IN ('use', 'result') QUALIFY kind = 'result'"
)
def asof_tool_name(spark, sf_dir):
    return transcripts.named_results(_as_events(spark, sf_dir)).where("kind = 'result'").select("file", "line_no", "tool")


@_query(f"SELECT user_id::varchar AS file, event_id AS line_no, kind, requests::bigint AS requests, segment::bigint AS segment FROM {_SEQ}")
def running_requests_and_segments(spark, sf_dir):
    return transcripts.sequence(_as_events(spark, sf_dir)).select("file", "line_no", "kind", "requests", "segment")


@_query(f"SELECT file, line_no, later::bigint AS later FROM (SELECT user_id::varchar AS file, event_id AS line_no, kind, max(requests) OVER (PARTITION BY user_id, segment) - requests AS later FROM {_SEQ}) WHERE kind = 'result'")
def later_requests(spark, sf_dir):
    return transcripts.later_requests(_as_events(spark, sf_dir)).select("file", "line_no", "later")


@_query(
    f"SELECT user_id::varchar AS file, count(*) FILTER (WHERE kind = 'boundary' AND coalesce(before, '') <> 'boundary') AS compactions FROM "
    f"(SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {_SEQ} WHERE kind IN ('boundary', 'result') OR new) GROUP BY user_id"
)
def compaction_segments(spark, sf_dir):
    seq = transcripts.sequence(_as_events(spark, sf_dir)).where("kind in ('boundary', 'result') or new")
    return seq.groupBy("file").agg(F.count_if("compaction").alias("compactions"))


_LAST = "(SELECT arg_max({'input': user_id, 'output': event_id % 11, 'cache_read': event_id % 101, 'write_1h': event_id % 5, 'write_5m': event_id % 3}, (user_id::varchar, event_id)) AS u FROM events WHERE event_type = 'signup' GROUP BY event_id % 40)"


@_query(
    f"SELECT requests, input, write_5m, write_1h, cache_read, output, round(input + write_5m * 1.25 + write_1h * 2 + cache_read * 0.1::double + output * 5, 6) AS units, round((input + write_5m * 1.25 + write_1h * 2)::double / (input + write_5m + write_1h), 9) AS write_price FROM "
    f"(SELECT count(*) AS requests, sum(u.input)::bigint AS input, sum(u.write_5m)::bigint AS write_5m, sum(u.write_1h)::bigint AS write_1h, sum(u.cache_read)::bigint AS cache_read, sum(u.output)::bigint AS output FROM {_LAST})"
)
def bill_units(spark, sf_dir):
    b = transcripts.bill(_as_events(spark, sf_dir))
    return b.withColumn("units", F.round("units", 6)).withColumn("write_price", F.round("write_price", 9))


_RESULTS = (
    f"(SELECT r.*, n.tool_name FROM (SELECT user_id, event_id, kind, max(requests) OVER (PARTITION BY user_id, segment) - requests AS later FROM {_SEQ}) r "
    f"JOIN (SELECT user_id, event_id, kind, coalesce(last_value(CASE WHEN kind = 'use' THEN (CASE WHEN tool = 0 THEN 'mcp__' ELSE 't' END) || tool END IGNORE NULLS) OVER (PARTITION BY user_id, use_id ORDER BY event_id), '(unknown)') AS tool_name FROM {_EV} WHERE kind IN ('use', 'result')) n USING (user_id, event_id) "
    f"WHERE r.kind = 'result')"
)
# what would replace a result: its minified form, if it costs fewer tokens and fewer bytes
_PROPS = (
    f"(SELECT *, CASE WHEN m < t AND strlen({_FRAMED}) < strlen(props) THEN m END AS a FROM (SELECT x.*, props, {_tokens('props')} AS t, {_tokens(_FRAMED)} AS m FROM {_RESULTS} x JOIN (SELECT event_id, props FROM events) USING (event_id)))"
)
_PART = "sum({x})::bigint AS {p}_total, coalesce(sum(CASE WHEN later > 0 THEN {x} END), 0)::bigint AS {p}_written, coalesce(sum(CASE WHEN later > 0 THEN {x} * (later - 1) END), 0)::bigint AS {p}_reread, sum({x} * later)::bigint AS {p}_turns"
_SUMS = f"count(*) AS results, count(a) AS replaced, {_PART.format(x='t', p='before')}, {_PART.format(x='coalesce(a, t)', p='after')}"
_REPORT = f"SELECT 'tool' AS scope, tool_name AS tool, {_SUMS} FROM {_PROPS} GROUP BY tool_name UNION ALL SELECT 'all', NULL, {_SUMS} FROM {_PROPS} UNION ALL SELECT 'hook', NULL, {_SUMS} FROM {_PROPS} WHERE starts_with(tool_name, 'mcp__')"


@_query(_REPORT)
def tool_report(spark, sf_dir):
    return transcripts.tool_report(transcripts.measured_results(_as_events(spark, sf_dir)))


_UNITS = f"(SELECT (i + f * 1.25::double + h * 2 + c * 0.1::double + o * 5) AS units, (i + f * 1.25::double + h * 2) / (i + f + h) AS price FROM (SELECT sum(u.input)::double AS i, sum(u.write_5m) AS f, sum(u.write_1h) AS h, sum(u.cache_read) AS c, sum(u.output) AS o FROM {_LAST}))"
_COST = "({s}.{p}_written * price + {s}.{p}_reread * 0.1::double)"


@_query(
    f"SELECT round(a.before_turns::double / a.before_total, 9) AS mean_later, round({_COST.format(s='a', p='before')} / units, 9) AS tool_share, "
    f"round(({_COST.format(s='a', p='before')} - {_COST.format(s='a', p='after')}) / units, 9) AS saving_share, round(({_COST.format(s='h', p='before')} - {_COST.format(s='h', p='after')}) / units, 9) AS hook_share "
    f"FROM (SELECT * FROM ({_REPORT}) WHERE scope = 'all') a, (SELECT * FROM ({_REPORT}) WHERE scope = 'hook') h, {_UNITS}"
)
def tool_shares(spark, sf_dir):
    ev = _as_events(spark, sf_dir)
    made = transcripts.shares(transcripts.tool_report(transcripts.measured_results(ev)), transcripts.bill(ev))
    return made.select(*[F.round(c, 9).alias(c) for c in made.columns])


# --- comprehension: lists are the orders of a customer or the lines of an order ---


@_query("SELECT o_custkey, count(*) AS answer FROM orders GROUP BY o_custkey")
def comprehension_count(spark, sf_dir):
    return comprehension.list_count(_table(spark, sf_dir, "orders"), "o_custkey")


@_query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS answer FROM orders GROUP BY o_custkey")
def comprehension_lookup(spark, sf_dir):
    return comprehension.list_lookup(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@_query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS answer FROM orders GROUP BY o_custkey")
def comprehension_count_by_value(spark, sf_dir):
    return comprehension.list_count_by_value(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "F")


@_query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey::varchar)), ',') AS answer FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey")
def comprehension_absent_field(spark, sf_dir):
    """A field that only dear orders have: its holders' keys."""
    return comprehension.list_having(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.col("o_totalprice") > 400000)


@_query("SELECT o_custkey, max(o_orderkey) AS answer FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders) WHERE o_totalprice = top GROUP BY o_custkey HAVING count(*) = 1")
def comprehension_argmax(spark, sf_dir):
    return comprehension.list_argmax(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@_query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS answer FROM lineitem GROUP BY l_orderkey")
def comprehension_count_conjunction(spark, sf_dir):
    return comprehension.list_count_conjunction(_table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")


def _keyed(purpose: str, n: str) -> str:
    """The options' hashes, in order."""
    return f"list_transform(range({n}), lambda i: md5(h || '{purpose}|' || i))"


def _chosen(purpose: str, n: str) -> str:
    """The place, from 1, of the option with the smallest hash."""
    return f"list_position({_keyed(purpose, n)}, list_min({_keyed(purpose, n)}))"


_LISTS = (
    "(SELECT *, list_filter([1, 2, 3], lambda k: len(list_distinct(cols[k])) > 1 AND 2 * len(list_distinct(cols[k])) <= n) AS g FROM (SELECT o_custkey AS doc, count(*) AS n, '1:' || o_custkey || '|' AS h, ['o_orderstatus', 'o_orderpriority', 'o_date'] AS names, "
    f"list(o_orderkey::varchar ORDER BY o_orderkey) AS keys, [list(o_orderstatus ORDER BY o_orderkey), list(o_orderpriority ORDER BY o_orderkey), list({_DAY} ORDER BY o_orderkey)] AS cols FROM orders GROUP BY o_custkey HAVING count(*) >= 6))"
)
_EQUAL = "names[{c}] || ' = \"' || cols[{c}][{e}] || '\"'"


@_query(
    "SELECT doc, doc || 'Q1' AS qid, 'count' AS kind, 'Count the entries of the document.' AS question, n::varchar AS answer FROM " + _LISTS + " UNION ALL "
    "SELECT doc, doc || 'Q2', 'lookup', 'Find the entry of the document with o_orderkey = ' || keys[e] || ' and give its ' || names[c] || '.', cols[c][e] FROM "
    f"(SELECT *, {_chosen('entry', 'n')} AS e, {_chosen('field', '3')} AS c FROM {_LISTS}) UNION ALL "
    f"SELECT doc, doc || 'Q3', 'count_by_value', 'Count the entries of the document with ' || {_EQUAL.format(c='c', e='e')} || '.', len(list_filter(cols[c], lambda x: x = cols[c][e]))::varchar FROM "
    f"(SELECT *, {_chosen('value', 'n')} AS e, g[{_chosen('group', 'len(g)')}] AS c FROM {_LISTS} WHERE len(g) > 0) UNION ALL "
    f"SELECT doc, doc || 'Q4', 'count_conjunction', 'Count the entries of the document with ' || {_EQUAL.format(c='c', e='e')} || ' and ' || {_EQUAL.format(c='d', e='e')} || ' at once.', "
    "len(list_filter(range(1, n + 1), lambda k: cols[c][k] = cols[c][e] AND cols[d][k] = cols[d][e]))::varchar FROM (SELECT *, g[two[1]] AS c, g[two[2]] AS d FROM (SELECT *, "
    f"{_chosen('both', 'n')} AS e, list_sort(list_transform(list_sort({_keyed('pair', 'len(g)')})[1:2], lambda x: list_position({_keyed('pair', 'len(g)')}, x))) AS two FROM {_LISTS} WHERE len(g) > 1))"
)
def comprehension_questions(spark, sf_dir):
    return comprehension.make_questions(_order_documents(spark, sf_dir), "o_custkey", "content")


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as graded answers: two renderings by parity, right where a label says so."""
    li = _table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("model"), F.when(F.col("l_linestatus") == "F", "grid").otherwise("input").alias("rendering"), F.col("l_linenumber").alias("repeat"), (F.col("l_partkey") % 500).cast("string").alias("qid"), F.concat(F.lit("k"), (F.col("l_suppkey") % 4).cast("string")).alias("kind"), (F.col("l_quantity") > 20).alias("correct"))


_GRADES = "(SELECT l_returnflag AS model, CASE WHEN l_linestatus = 'F' THEN 'grid' ELSE 'input' END AS rendering, l_linenumber AS \"repeat\", (l_partkey % 500)::varchar AS qid, 'k' || (l_suppkey % 4) AS kind, l_quantity > 20 AS correct FROM lineitem)"


@_query(f"SELECT model, rendering, coalesce(kind, 'all') AS kind, count(*) FILTER (WHERE correct) AS correct, count(*) AS total FROM {_GRADES} GROUP BY GROUPING SETS ((model, rendering, kind), (model, rendering))")
def accuracy_grid(spark, sf_dir):
    return comprehension.accuracy(_grades(spark, sf_dir))



_LOG_BINOMIAL = "lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0)"


@_query(
    f"SELECT *, round(least(1.0, 2 * list_sum(list_transform(range(0, least(only_first, only_second) + 1), lambda i: exp({_LOG_BINOMIAL.replace('n ', '(only_first + only_second) ').replace('(n', '((only_first + only_second)')})))), 9) AS p FROM ("
    f"SELECT a.model, count(*) FILTER (WHERE a.correct AND b.correct) AS \"both\", count(*) FILTER (WHERE a.correct AND NOT b.correct) AS only_first, count(*) FILTER (WHERE NOT a.correct AND b.correct) AS only_second, count(*) FILTER (WHERE NOT a.correct AND NOT b.correct) AS neither "
    f"FROM (SELECT model, \"repeat\", qid, bool_and(correct) AS correct FROM {_GRADES} WHERE rendering = 'grid' GROUP BY ALL) a JOIN (SELECT model, \"repeat\", qid, bool_and(correct) AS correct FROM {_GRADES} WHERE rendering = 'input' GROUP BY ALL) b USING (model, \"repeat\", qid) GROUP BY a.model)"
)
def paired_comparison(spark, sf_dir):
    once = _grades(spark, sf_dir).groupBy("model", "rendering", "repeat", "qid").agg(F.bool_and("correct").alias("correct"))
    return comprehension.paired(once, "grid", "input").withColumn("p", F.round("p", 9))


@_query(
    "SELECT b, c, round(1000003 * least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2.0))) FROM range(0, 12) r(i) WHERE i <= least(b, c))))::bigint AS p FROM (SELECT DISTINCT p_size % 12 AS b, (p_partkey % 9)::integer AS c FROM part)"
)
def sign_tests(spark, sf_dir):
    pairs = _table(spark, sf_dir, "part").select((F.col("p_size") % 12).alias("b"), (F.col("p_partkey") % 9).cast("int").alias("c")).distinct()
    return pairs.select("b", "c", F.round(1000003 * comprehension.sign_test(F.col("b"), F.col("c"))).cast("long").alias("p"))


@_query("SELECT rep AS \"repeat\", doc, model, rendering, i, j FROM (SELECT doc_id AS doc FROM documents), unnest([1, 2]) a(rep), (VALUES ('small', 0), ('large', 1)) b(model, i), (VALUES ('input', 0), ('grid', 1)) c(rendering, j)")
def plan_calls(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    return comprehension.plan_calls(docs, ["small", "large"], ["input", "grid"], 2).select("repeat", "doc", "model", "rendering", "place.i", "place.j")


# --- messages ---


_STATS = (
    "'{\"bytesBefore\":' || z || ',\"bytesAfter\":' || z || ',\"estTokensBefore\":' || t || ',\"estTokensAfter\":' || t || ',\"encoder\":\"passthrough\",\"byteRatio\":1.0,\"tokenRatio\":1.0,\"fidelity\":\"lossless\"}'"
)


@_query(
    "SELECT event_id, '{\"jsonrpc\":\"2.0\",\"id\":' || event_id || ',\"result\":{\"content\":[{\"type\":\"text\",\"text\":\"' || replace(stats, '\"', '\\\"') || '\"}],\"structuredContent\":{\"compressed\":false,\"stats\":' || stats || '},\"isError\":false}}' AS reply "
    f"FROM (SELECT event_id, {_STATS} AS stats FROM (SELECT event_id, strlen(props) AS z, {_tokens('props')} AS t FROM events))"
)
def rpc_estimate_props(spark, sf_dir):
    """Each event's properties sent as a call of the estimate tool, answered line by line."""
    e = _table(spark, sf_dir, "events")
    call = F.struct(F.lit("2.0").alias("jsonrpc"), F.col("event_id").alias("id"), F.lit("tools/call").alias("method"), F.struct(F.lit(rpc.TOOLS[2]).alias("name"), F.struct(F.col("props").alias("text")).alias("arguments")).alias("params"))
    return rpc.replies(e.select("event_id", F.to_json(call).alias("line")), "event_id", "line")
