"""The engine on Spark: compression, archives, shredding, relation mode, transcripts, messages, oracles."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from loomwright import functions as L
from loomwright import plans, sources
from loomwright.kernel import archive, messages, parse, price, protocol, questions
from loomwright.operators import Config, compress, comprehension, decompress, grid_text, shred, tables, transcripts
from loomwright.operators.compress import exact_counts, rendering, validate
from loomwright.streaming import rpc

TABLE = "[" + ", ".join(f'{{"id": {i}, "name": "item {i}", "ok": true}}' for i in range(20)) + "]"
LINES = "\n".join(f'{{"id":{i},"level":"info"}}' for i in range(12)) + "\n"


def test_compress(spark):
    texts = [TABLE, LINES, '{"a":1}', "not json", "", None, "[" * 600 + "]" * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["artifact"] for r in compress(df, "t").orderBy("i").collect()]
    assert (got[0]["stats"]["encoder"], got[1]["stats"]["encoder"], got[2]["stats"]["encoder"]) == (5, 4, 0)
    assert got[0]["rendering"].startswith("#tkfd1 grid\n\n#20[id,name,ok=true]\n+0,")
    assert got[1]["rendering"].startswith('#tkfd1 jsonl\n\n#12["id","level"]\n+[0,"info"]\n')
    assert got[2]["rendering"] == '{"a":1}' and got[2]["stats"]["byte_ratio"] == 1.0
    assert [(g["error"]["code"], g["error"]["byte_offset"]) for g in got[3:5]] == [("invalid_json", 0), ("invalid_json", 0)]
    assert got[5] is None and got[6]["error"]["code"] == "depth_exceeded" and got[6]["error"]["depth"] == 513
    for g, t in zip(got[:3], texts, strict=False):
        s = g["stats"]
        assert s["est_tokens_before"] == price.heuristic(t) and s["est_tokens_after"] == price.heuristic(g["rendering"])
        assert bytes(g["archive"]) == archive.pack(t.encode())
        assert s["encoder"] == 0 or s["est_tokens_after"] < s["est_tokens_before"]


def test_margin_and_profiles(spark):
    df = spark.createDataFrame([(TABLE,)], "t string")
    stats = lambda **k: compress(df, "t", Config(**k)).first()["artifact"]["stats"]
    assert stats(min_saving_bps=20_000)["encoder"] == 0 and stats(min_saving_bps=20_000)["min_saving_bps"] == 10_000
    assert stats(min_saving_bps=20_000)["gate_rejected_candidate"]
    assert stats(profile="conservative")["encoder"] == 0  # single spaces cost nothing, so nothing is won
    pretty = spark.createDataFrame([(json.dumps(json.loads(TABLE), indent=4),)], "t string")
    assert compress(pretty, "t", Config("conservative")).first()["artifact"]["stats"]["encoder"] == 1
    assert stats(estimator=L.BYTES)["est_tokens_before"] == len(TABLE)
    with pytest.raises(FileNotFoundError):
        L.exact_estimator("o200k")


def test_exact_counts(spark, tmp_path):
    # a vocabulary of the 256 bytes and three merges: counts follow from how the patterns cut
    ranks = [bytes([b]) for b in range(256)] + [b"12", b"ab", b"Ab"]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(r).decode()} {i}\n" for i, r in enumerate(ranks)))
    counters = {name: L.exact_estimator(name, str(path)) for name in ("cl100k", "o200k")}
    # digits go in threes, a mark joins the letters behind it, letters of both cases are cut by the second pattern only
    for text, one, two in [("12", 1, 1), ("121212", 4, 4), ("abab", 2, 2), ("xAb", 2, 2), ("a/b\n/ab", 6, 6), ("", 0, 0), ("<|endoftext|>", 13, 13), ("'S12", 3, 3)]:
        assert (counters["cl100k"].scalar(text), counters["o200k"].scalar(text)) == (one, two), text
    assert [c.id for c in counters.values()] == [2, 3]
    df = spark.createDataFrame([(0, TABLE), (1, '{"a":1}'), (2, "prose"), (3, None)], "i int, t string")
    counter = counters["cl100k"]
    got = {r["i"]: r for r in exact_counts(compress(df, "t"), "t", counter).collect()}
    assert got[0]["exact"]["before"] == counter.scalar(TABLE) and got[0]["exact"]["after"] == counter.scalar(got[0]["artifact"]["rendering"]) < got[0]["exact"]["before"]
    assert (got[1]["exact"]["before"], got[1]["exact"]["after"], got[1]["exact"]["ratio"], got[1]["exact"]["tokenizer_id"]) == (7, 7, 1.0, 2)
    assert got[2]["exact"] is None and got[3]["exact"] is None
    by_bytes = {r["i"]: r["replace"] for r in transcripts.hook_replaces(df, "t").collect()}
    exactly = {r["i"]: r["replace"] for r in transcripts.hook_replaces(df, "t", counter=counter).collect()}
    assert by_bytes == exactly == {0: True, 1: False, 2: False, 3: False}
    # dearer by an exact price, though shorter in bytes
    dear = L.Estimator("dear", 9, lambda c: F.when(c.startswith("#"), 10**6).otherwise(1), len)
    assert not transcripts.hook_replaces(df.where("i = 0"), "t", counter=dear).first()["replace"]


def test_archives_fail_closed(spark):
    good = archive.pack(b"hello")
    cases = [(good, None), (b"", "bad_magic"), (b"XKFD" + good[4:], "bad_magic"), (good[:4], "corrupt"), (good[:4] + b"\2" + good[5:], "unsupported_version"), (good[:4] + b"\0" + good[5:], "corrupt"), (good[:5] + b"\1" + good[6:], "corrupt"), (good[:8] + b"\x08" + good[9:], "reserved_bits_set"), (good[:8] + b"\1" + good[9:], "corrupt"), (good[:10] + b"\x85\0" + good[11:], "corrupt"), (good + b"x", "corrupt"), (good[:-1] + b"x", "checksum_mismatch"), (good[:20], "corrupt"), (None, None)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    got = [r["recovered"] for r in decompress(df, "b").orderBy("i").collect()]
    assert [g["code"] for g in got] == [code for _, code in cases]
    assert bytes(got[0]["original"]) == b"hello" and all(g["original"] is None for g in got[1:])
    for at in range(len(good)):
        for bit in range(8):
            with pytest.raises(archive.Damaged):
                archive.unpack(good[:at] + bytes([good[at] ^ 1 << bit]) + good[at + 1 :])


def test_columns(spark):
    texts = ["", "a b", "K denied K", "abcdefghijklmno", "é  a\tb\x0b", "\0\0", "EACCES", "ERROR TS9", "a\n\nb "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", L.heuristic_tokens(F.col("t")).alias("n"), L.protected(F.col("t")).alias("p"), L.ascii_lower(F.col("t")).alias("low")).collect()
    assert [r["n"] for r in got] == [price.heuristic(t) for t in texts]
    assert [tuple(r["p"]) if r["p"] else None for r in got] == [price.protected(t) for t in texts]
    assert got[2]["low"] == "k denied K"
    numbers = [0, 1, 127, 128, 16383, 16384, 2**28 - 1, 2**28, 2**40]
    hexed = spark.createDataFrame([(n,) for n in numbers], "n long").select(L.uleb128_hex(F.col("n")).alias("h")).collect()
    assert [bytes.fromhex(r["h"]) for r in hexed] == [archive.uleb128(n) for n in numbers]
    coded = ["", "YQ==", "YR==", "Y Q==", "YWI=", "YWJj", "YWJ", "Y===", "YQ==YQ=="]
    raw = spark.createDataFrame([(c,) for c in coded], "c string").select(L.base64_strict(F.col("c")).alias("r")).collect()
    assert [None if r["r"] is None else bytes(r["r"]) for r in raw] == [b"", b"a", None, None, b"ab", b"abc", None, None, None]
    answers = [("b, 'A'", "a,b"), ("1.50", "1.5"), ('"x"', "x"), (" ,", "")]
    said = spark.createDataFrame(answers, "a string, w string").select("w", L.normalise_answer(F.col("a")).alias("n"), comprehension.normalised("a").alias("p")).collect()
    assert all(r["w"] == r["n"] == r["p"] for r in said)


def test_shred(spark):
    df = spark.createDataFrame([(1, '{"é":[1]}'), (2, "no"), (3, None), (4, "1\n[2]\n")], "i long, t string")
    got = shred(df, "i", "t").orderBy("doc_id", "idx").collect()
    assert [(r["kind"], r["start"], r["end"]) for r in got if r["doc_id"] == 1] == [("ObjectStart", 0, 1), ("Key", 1, 5), ("ArrayStart", 6, 7), ("Number", 7, 8), ("ArrayEnd", 8, 9), ("ObjectEnd", 9, 10)]
    assert {r["doc_id"] for r in got} == {1, 4}


def test_relation_mode_equals_document_mode(spark):
    rows = [(g, i, f"n{i % 3}", None if i % 4 else 1.5, "same") for g in range(3) for i in range(6)]
    df = spark.createDataFrame(rows, "g int, i int, name string, x double, c string")
    texts = {r["g"]: r["content"] for r in tables.documents_of(df, ["g"], ["i", "name", "x", "c"], ["i"]).collect()}
    from loomwright.kernel import encode

    for r in grid_text(df, ["g"], ["i", "name", "x", "c"], ["i"]).collect():
        assert r["body"] == encode.grid(parse.parse(texts[r["g"]]))


TRANSCRIPT = [
    {"type": "assistant", "requestId": "r1", "message": {"usage": {"input_tokens": 10, "output_tokens": 2, "cache_read_input_tokens": 100, "cache_creation": {"ephemeral_1h_input_tokens": 40, "ephemeral_5m_input_tokens": 0}}, "content": [{"type": "tool_use", "id": "t1", "name": "mcp__srv__list"}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": TABLE}]}},
    {"type": "assistant", "requestId": "r2", "message": {"usage": {"input_tokens": 10, "output_tokens": 2, "cache_read_input_tokens": 100, "cache_creation": {"ephemeral_1h_input_tokens": 40}}, "content": [{"type": "tool_use", "id": "t2", "name": "Bash"}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t2", "content": [{"type": "text", "text": "secret-"}, {"type": "image"}, {"type": "text", "text": "listing.txt"}]}]}},
    {"type": "assistant", "message": {"id": "r3", "usage": {"input_tokens": 10, "output_tokens": 2, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 99, "cache_creation": {"ephemeral_1h_input_tokens": 40}}}},
    {"isSidechain": True, "type": "assistant"},
]


def test_transcripts(spark, tmp_path):
    path = tmp_path / "p" / "a.jsonl"
    path.parent.mkdir()
    path.write_bytes("\n".join(json.dumps(r) for r in TRANSCRIPT).encode() + b"\nnot json\n\xff\n\n")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "l.jsonl").symlink_to(path)
    found = sources.walk(str(tmp_path))
    assert (found.files, found.skipped, found.unreadable) == ([str(path)], 1, 0)
    ev = transcripts.events(sources.read_lines(spark, found.files))
    c = transcripts.counters(ev).first()
    assert (c["files"], c["records"], c["sidechain"], c["unparsed"], c["compactions"]) == (1, 5, 1, 2, 0)
    b = transcripts.bill(ev).first()
    assert (b["requests"], b["input"], b["write_1h"], b["cache_read"], b["output"]) == (3, 30, 120, 300, 6)
    assert b["units"] == pytest.approx(330.0) and b["write_price"] == pytest.approx(1.8)
    results = transcripts.measured_results(ev)
    rows = {r["tool"]: r for r in results.collect()}
    assert (rows["mcp__srv__list"]["later"], rows["Bash"]["later"]) == (2, 1) and rows["Bash"]["before"] == 7 and rows["Bash"]["after"] is None
    before, after = price.heuristic(TABLE), rows["mcp__srv__list"]["after"]
    report = transcripts.tool_report(results)
    s = transcripts.shares(report, transcripts.bill(ev)).first()
    assert s["mean_later"] == pytest.approx((before * 2 + 7) / (before + 7))
    assert s["tool_share"] == pytest.approx((before * 1.9 + 7 * 1.8) / 330)
    nothing = {r["scope"]: (r["tool"], r["results"], r["after_total"]) for r in transcripts.tool_report(results.limit(0)).collect()}
    assert nothing == {"all": (None, 0, 0), "hook": (None, 0, 0)}
    lines = report.collect()
    table = transcripts.report_table([*lines, lines[0].asDict() | {"scope": "tool", "tool": "a\x1b[2J'\n\u202e"}]).splitlines()
    assert table[1].split()[:2] == ["tool", "results"] and any(x.startswith("mcp__srv__list") for x in table) and table[-2].startswith("all tools")
    assert any(x.startswith("a\\u{1b}[2J\\'\\n\\u{202e} ") for x in table) and len({len(x) for x in table[1:]}) == 1
    assert [s["saving_share"], s["hook_share"]] == [pytest.approx((before - after) * 1.9 / 330)] * 2


def test_lines_of_split_files(spark, tmp_path):
    lines = [b"line %d \xc3\xa9" % i * (i % 7) for i in range(4000)]
    lines[5], lines[9] = b"\xff\xfe\r", b"carriage\rreturn"
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(lines) + b"\n")
    (tmp_path / "b.jsonl").write_bytes(b"\n\nlast")
    (tmp_path / "c.jsonl").write_bytes(b"")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = sources.read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        got = {(r["path"].rsplit("/", 1)[-1], r["line_no"]): bytes(r["line"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert got == {("a.jsonl", i): x for i, x in enumerate(lines)} | {("b.jsonl", 0): b"", ("b.jsonl", 1): b"", ("b.jsonl", 2): b"last"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e.jsonl").write_bytes(b"x")
    found = sources.walk(f"file://{tmp_path}", spark=spark)
    assert [f.rsplit("/", 1)[-1] for f in found.files] == ["a.jsonl", "b.jsonl", "c.jsonl", "e.jsonl"] and found.skipped == 0
    assert sources.walk(f"file://{tmp_path}/a.jsonl", spark=spark).files == [f"file://{tmp_path}/a.jsonl"]
    with pytest.raises(OSError):
        sources.walk(f"file://{tmp_path}/none", spark=spark)


def test_protocol_json():
    assert protocol.loads('{"a":[1,2.0,"\\ud83d\\ude00",null,true,{}]}') == {"a": [1, 2.0, "😀", None, True, {}]}
    assert isinstance(protocol.loads("9223372036854775808"), float)
    for text in ('{"a":1,"a":2}', '{"a":1,"\\u0061":2}', '"\\ud800"', "1e999", "[" * 129 + "]" * 129, "[1,]"):
        with pytest.raises(parse.Rejected):
            protocol.loads(text)


def ask(method, params=None, message_id=1, session=None):
    line = json.dumps({"jsonrpc": "2.0", "id": message_id, "method": method, "params": params or {}})
    return json.loads(messages.handle_line(line, session or messages.Session()))


def test_messages():
    session = messages.Session()
    assert ask("initialize", {"protocolVersion": "2025-06-18"}, session=session)["result"]["protocolVersion"] == "2025-06-18"
    assert ask("initialize", {"protocolVersion": "2025-06-18"}, session=session)["error"]["code"] == -32600
    assert ask("ping")["result"] == {} and ask("nope")["error"]["code"] == -32601
    assert ask("ping", {"_meta": {messages.VERSION_KEY: "1999-01-01"}})["error"]["code"] == -32022
    modern = {messages.VERSION_KEY: messages.FIRST_MODERN}
    for meta, code in (("2025-11-25", -32602), ({messages.VERSION_KEY: 5}, -32602), (modern, -32602), (modern | {messages.ABILITIES_KEY: []}, -32602), (modern | {messages.ABILITIES_KEY: {}}, None), ({messages.VERSION_KEY: "2024-11-05"}, None), ({}, None)):
        assert ask("ping", {"_meta": meta}).get("error", {}).get("code") == code
    assert ask("initialize", {})["result"]["protocolVersion"] == ask("initialize", {"protocolVersion": messages.FIRST_MODERN})["result"]["protocolVersion"] == "2025-11-25"
    told = ask("server/discover")["result"]
    assert told["supportedVersions"][0] == messages.FIRST_MODERN and told["serverInfo"]["name"] and told["instructions"] and (told["ttlMs"], told["cacheScope"]) == (3_600_000, "public")
    assert ask("tools/list", {"cursor": "x"})["error"]["code"] == -32602 and ask("tools/list", {"cursor": None})["result"]["cacheScope"] == "public"
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["compress", "decompress", "estimate"]
    done = ask("tools/call", {"name": "compress", "arguments": {"text": TABLE}})["result"]
    assert done["structuredContent"]["compressed"] and done["content"][0]["text"].startswith("#tkfd1 grid")
    back = ask("tools/call", {"name": "decompress", "arguments": {"archive": done["structuredContent"]["archive"]}})["result"]
    assert back["structuredContent"]["text"] == TABLE
    broken = base64.b64encode(b"TKFD").decode()
    assert ask("tools/call", {"name": "decompress", "arguments": {"archive": broken}})["result"]["isError"]
    plain = ask("tools/call", {"name": "compress", "arguments": {"text": "prose"}})["result"]
    assert (plain["structuredContent"]["compressed"], plain["content"][0]["text"], plain["isError"]) == (False, "prose", False)
    assert ask("tools/call", {"name": "compress", "arguments": {}})["error"]["code"] == -32602
    say = lambda line, limit=messages.MAX_BYTES: messages.handle_line(line, messages.Session(), limit)
    assert say("  ") is None and say('{"method":5}') is None and say(b"\xff") is not None
    assert json.loads(say("{"))["error"]["code"] == -32700 and json.loads(say("[]"))["error"]["code"] == -32600
    both = json.loads(say('[{"jsonrpc":"2.0","id":1,"method":"ping"},{"method":"x"},{"jsonrpc":"2.0","id":"b","method":"ping"}]'))
    assert [r["id"] for r in both] == [1, "b"]
    small = json.loads(say('{"jsonrpc":"2.0","id":7,"method":"tools/list"}', 120))
    assert small["id"] == 7 and "error" in small
    # a member that does not fit is refused alone, and the batch goes on while refusals fit
    ping, wide = '{"jsonrpc":"2.0","id":%d,"method":"ping"}', '{"jsonrpc":"2.0","id":%d,"method":"tools/list"}'
    batch = f"[{ping % 1},{wide % 2},{ping % 3}]"
    some = json.loads(say(batch, 400))
    assert [(r["id"], "error" in r) for r in some] == [(1, False), (2, True), (3, False)] and "of 400 bytes" in some[1]["error"]["message"]
    assert json.loads(say(batch, 130))["error"]["code"] == -32603


def test_message_stream(spark, tmp_path):
    hello = json.dumps({"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2025-03-26"}})
    rows = [("a", 1, hello), ("a", 2, hello), ("b", 1, hello), ("b", 2, " ")]
    spark.createDataFrame(rows, "session string, place long, line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, place long, line string").parquet(str(tmp_path / "in"))
    q = rpc.session_replies(stream).writeStream.format("memory").queryName("said").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["session"], r["place"]): "error" in json.loads(r["reply"]) for r in spark.sql("select * from said").collect()}
    assert got == {("a", 1): False, ("a", 2): True, ("b", 1): False}


def test_comprehension(spark, tmp_path):
    docs = comprehension.generate(7, 8)
    assert docs == comprehension.generate(7, 8) and {t for _, t, _ in docs} == set(comprehension.FAMILIES)
    df = spark.createDataFrame([(d, t) for d, _, t in docs], "doc string, text string")
    asked = comprehension.make_questions(df, "doc", "text", 3)
    rows = asked.collect()
    assert {r["kind"] for r in rows} == set(questions.KINDS) and len(rows) >= 5 * 8
    for doc, _, text in docs:
        _, items = questions.find_list(questions.loads(text))
        assert [r["answer"] for r in rows if r["doc"] == doc and r["kind"] == "count"] == [str(len(items))]
    replies = [(d, "m", r, 1, "```json\n" + json.dumps({x["qid"]: x["answer"] if r == "grid" or x["kind"] == "count" else "?" for x in rows if x["doc"] == d}) + "\n```") for d, _, _ in docs for r in ("input", "grid")]
    graded = comprehension.grade(spark.createDataFrame(replies, "doc string, model string, rendering string, repeat int, reply string"), asked)
    cells = {(r["rendering"], r["kind"]): (r["correct"], r["total"]) for r in comprehension.accuracy(graded).collect()}
    assert cells["grid", "all"] == (len(rows), len(rows)) and cells["input", "all"] == (8, len(rows))
    pair = comprehension.paired(graded, "input", "grid").first()
    assert (pair["both"], pair["only_first"], pair["only_second"], pair["neither"]) == (8, 0, len(rows) - 8, 0)
    assert pair["p"] == pytest.approx(questions.sign_test(0, len(rows) - 8), rel=1e-9)
    said = comprehension.write_run(str(tmp_path), df, asked, spark.createDataFrame(replies, "doc string, model string, rendering string, repeat int, reply string"), graded)
    assert f"| m | grid | all | {len(rows)} | {len(rows)} | 100.0 % |" in said and f"| m | 8 | {len(rows) - 8} | 0 | 0 |" in said
    assert spark.read.parquet(f"{tmp_path}/calls").count() == len(replies) and spark.read.parquet(f"{tmp_path}/questions").count() == len(rows)
    assert comprehension.plan_calls(df.select("doc"), ["a", "b"], ["x"], 2).count() == 32
    assert comprehension.plan_calls(df.select("doc"), ["a", "b"], ["x"], 2, cap=32).count() == 32
    for cap in (31, 0, 201):
        with pytest.raises(ValueError, match="cap"):
            comprehension.plan_calls(df.select("doc"), ["a", "b"], ["x"], 2, cap=cap)
    calls = [("m", "grid", 1, '{"Q1": 2}', 0.5, 10, 3), ("m", "grid", 3, "no object", 0.25, 20, 4), ("m", "grid", 3, None, 0.0, None, None), ("m", "input", 1, "{}", 0.125, 5, 1)]
    run = {r["rendering"]: tuple(r)[2:] for r in comprehension.run_summary(spark.createDataFrame(calls, "model string, rendering string, attempts int, reply string, cost double, input_tokens int, output_tokens int")).collect()}
    assert run == {"grid": (7, 1, 1, 0.75, 30, 7), "input": (1, 0, 0, 0.125, 5, 1)}
    assert questions.cap_error(10, 9) and questions.cap_error(1, 201) and questions.cap_error(1, 0) and questions.cap_error(9, 9) is None
    assert questions.sign_test(0, 0) == 1 and questions.sign_test(1, 8) == pytest.approx(0.0390625)
    assert questions.parse_answers('x {"a": 1} y') == {"a": 1.0} and questions.parse_answers("[1]") is None


@pytest.fixture
def wide_batches(spark):
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20)}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield lambda: [int(spark.conf.get(k)) for k in keys]
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_batches_of_bounded_bytes(spark, wide_batches):
    # a price in Python says how many texts it was given at once
    @F.pandas_udf("long")
    def given(texts):
        return texts.map(lambda _: len(texts))

    df = spark.range(3000, numPartitions=1).select(F.concat(F.lit('["'), F.repeat(F.lit("x"), 20_000), F.lit('"]')).alias("t"))
    done = compress(df, "t", Config(estimator=L.Estimator("given", 9, given, len)))
    assert wide_batches()[0] <= 5000 and wide_batches()[1] <= 1 << 20
    assert done.agg(F.max("artifact.stats.est_tokens_before")).first()[0] <= (1 << 20) // 20_000 + 1


@pytest.mark.parametrize("start", [lambda d: rendering(d, "t", 1), lambda d: d.select(validate(F.col("t"))), lambda d: shred(d, "i", "t"), lambda d: decompress(d.select(F.col("t").cast("binary").alias("t")), "t"), lambda d: comprehension.make_questions(d, "i", "t")])
def test_batches_of_every_reader(spark, wide_batches, start):
    start(spark.createDataFrame([(1, "[1]")], "i int, t string"))
    assert wide_batches()[0] <= 5000 and wide_batches()[1] <= 1 << 20


def test_refused_documents_are_read_once(spark):
    df = spark.createDataFrame([(1, "prose"), (2, "[1]"), (3, None)], "i int, t string")
    errors = compress(df, "t").where(F.col("artifact.error").isNotNull()).select("i", "artifact.error.code", "artifact.error.byte_offset")
    assert errors._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in errors.collect()] == [(1, "invalid_json", 0)]


def test_documents_are_rendered_once(spark):
    df = spark.createDataFrame([(1, '[{"a":1},{"a":2}]'), (2, "[1]"), (3, None), (4, "[")], "i int, t string")
    found = rendering(df, "t", 5).where("rendering is not null").select("i", "rendering")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in found.collect()] == [(1, "#tkfd1 grid\n\n#2[a]\n+1\n+2\n")]
    faults = df.select("i", validate(F.col("t")).alias("e")).where("e is not null").select("i", "e.code", "e.byte_offset")
    assert faults._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in faults.collect()] == [(4, "invalid_json", 1)]


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.sql(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return c, folder


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, oracle, name):
    c, folder = oracle
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    df = plans.queries()[name](spark, folder)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[k]) for k in names) for r in df.collect())
    result = c.sql(plans.oracle_sql()[name])
    assert sorted(result.columns) == names
    assert got == sorted(tuple(plain(r[result.columns.index(k)]) for k in names) for r in result.fetchall())
