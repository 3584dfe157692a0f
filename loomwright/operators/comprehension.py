"""The comprehension job: questions about documents, grading, accuracy and paired comparison."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..batches import small_batches
from ..kernel import questions as Q


def _ask(seed: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(doc, q["id"], q["kind"], q["text"], q["answer"]) for q in Q.questions(str(doc), text or "", seed)]
                except ValueError:
                    continue
            kinds = [batch.schema.field(0).type, *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc", "qid", "kind", "question", "answer"])

    return run


def make_questions(docs: DataFrame, key: str, text: str, seed: int = 1) -> DataFrame:
    """(doc, qid, kind, question, answer) of every document that holds a list; choices are keyed by the seed and the document's key."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_ask(seed), f"doc {rows.schema['doc'].dataType.simpleString()}, qid string, kind string, question string, answer string")


@F.pandas_udf(T.StringType())
def normalised(answers: pd.Series) -> pd.Series:
    return answers.map(Q.normalise)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def answers_of(replies: pd.Series) -> pd.Series:
    """Question id -> normalised answer of a reply; null if no object can be read from it."""

    def one(reply):
        found = Q.parse_answers(reply)
        return None if found is None else {k: Q.normalise(v) for k, v in found.items()}

    return replies.map(one)


def plan_calls(docs: DataFrame, models: list[str], renderings: list[str], repeats: int = 1, cap: int | None = None) -> DataFrame:
    """(repeat, doc, model, rendering, place): document by document within a repeat; the lists are literals.

    With a cap, a plan of more calls is refused, as is a cap beyond the hard one.
    """
    if cap is not None and (why := Q.cap_error(docs.count() * len(models) * len(renderings) * repeats, cap)):
        raise ValueError(why)
    each = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    lists = [F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(xs)])) for xs in (models, renderings)]
    out = docs.select("doc").withColumn("repeat", each).withColumn("m", lists[0]).withColumn("r", lists[1])
    return out.select("repeat", "doc", F.col("m.x").alias("model"), F.col("r.x").alias("rendering"), F.struct("repeat", "doc", "m.i", F.col("r.i").alias("j")).alias("place"))


def grade(calls: DataFrame, questions: DataFrame) -> DataFrame:
    """(doc, model, rendering, repeat, qid, kind, answer, given, correct) of calls (doc, model, rendering, repeat, reply)."""
    read = calls.withColumn("answers", answers_of("reply"))
    both = read.join(questions, "doc")
    given = F.coalesce(F.try_element_at("answers", "qid"), F.lit(""))
    return both.select("doc", "model", "rendering", "repeat", "qid", "kind", "answer", given.alias("given"), (given == normalised("answer")).alias("correct"))


def accuracy(grades: DataFrame) -> DataFrame:
    """(model, rendering, kind, correct, total): by kind, and over all kinds with kind `all`."""
    sums = [F.count_if("correct").alias("correct"), F.count("*").alias("total")]
    cells = grades.groupBy("model", "rendering", "kind").agg(*sums)
    return cells.unionByName(cells.groupBy("model", "rendering").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total")).withColumn("kind", F.lit("all")))


def run_summary(calls: DataFrame) -> DataFrame:
    """(model, rendering, calls, failed, unparsed, cost, input_tokens, output_tokens) of a run.

    ``calls`` has (model, rendering, attempts, reply, cost, input_tokens, output_tokens); a call without
    reply failed, one whose reply holds no object is unparsed.
    """
    read = calls.withColumn("_read", answers_of("reply").isNotNull())
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return read.groupBy("model", "rendering").agg(F.sum("attempts").alias("calls"), F.count_if(F.col("reply").isNull()).alias("failed"), F.count_if(F.col("reply").isNotNull() & ~F.col("_read")).alias("unparsed"), *map(total, ("cost", "input_tokens", "output_tokens")))


def sign_test(first: Column, second: Column) -> Column:
    """Exact two-sided sign test in the JVM: binomial weights relative to 2^n, summed in logs to stay finite."""
    n = (first + second).cast("double")
    least = F.least(first, second).cast("long")
    state = F.struct(F.lit(0.0).alias("tail"), (-n * F.log(F.lit(2.0))).alias("w"))
    step = lambda s, i: F.struct((s["tail"] + F.exp(s["w"])).alias("tail"), (s["w"] + F.log(F.greatest(n - i, F.lit(1e-300))) - F.log(i + 1.0)).alias("w"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), least), state, step, lambda s: s["tail"])
    return F.least(F.lit(1.0), 2 * total)


def paired(grades: DataFrame, first: str, second: str) -> DataFrame:
    """(model, both, only_first, only_second, neither, p): questions asked under both renderings."""
    side = lambda r, c: grades.where(F.col("rendering") == r).select("model", "repeat", "qid", F.col("correct").alias(c))
    both = side(first, "a").join(side(second, "b"), ["model", "repeat", "qid"])
    n = both.groupBy("model").agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(~F.col("a") & F.col("b")).alias("only_second"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"))
    return n.withColumn("p", sign_test(F.col("only_first"), F.col("only_second")))


# The six kinds as relational queries over a table whose groups are the lists.


def list_count(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("answer"))


def list_lookup(df: DataFrame, group: str, key: str, field: str) -> DataFrame:
    """The field of the record with the smallest key of each list."""
    return df.groupBy(group).agg(F.min(key).alias(key), F.min_by(field, key).alias("answer"))


def list_count_by_value(df: DataFrame, group: str, field: str, value) -> DataFrame:
    return df.groupBy(group).agg(F.count_if(F.col(field) == F.lit(value)).alias("answer"))


def list_having(df: DataFrame, group: str, key: str, present: Column) -> DataFrame:
    """The sorted keys of the records that have an optional field."""
    return df.where(present).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("answer"))


def list_argmax(df: DataFrame, group: str, key: str, field: str) -> DataFrame:
    """The key of the record with the largest field, where only one has it."""
    top = F.max(field).over(Window.partitionBy(group))
    return df.withColumn("_top", top).where(F.col(field) == F.col("_top")).groupBy(group).agg(F.count("*").alias("_n"), F.max(key).alias("answer")).where("_n = 1").drop("_n")


def list_count_conjunction(df: DataFrame, group: str, one: Column, two: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count_if(one & two).alias("answer"))


# Fixed words for generated documents.
_NOUNS = ("asset", "badge", "cable", "device", "gateway", "invoice", "ledger", "meter", "network", "panel", "queue", "relay", "sensor", "server", "ticket", "vendor", "window", "zone")
FAMILIES = ("describe_table", "query_table", "list_instances", "audit_events")


def generate(seed: int, count: int) -> list[tuple[str, str, str]]:
    """(id, tool, text) of invented tool results in four shapes, the same for a seed; optional fields are on few records."""
    rng, out = Q.Mulberry32(seed), []
    for i in range(count):
        tool = FAMILIES[i % len(FAMILIES)]
        n = rng.int(8, 60)
        if tool == "describe_table":
            rows = [{"name": f"u_{rng.pick(_NOUNS)}_{k}", "label": rng.pick(_NOUNS).title(), "type": rng.pick(["string", "integer", "boolean", "reference"]), "max_length": rng.pick([32, 40, 100, 255]), "mandatory": rng.int(0, 3) == 0, "read_only": rng.int(0, 5) == 0, "display_order": 10 * (k + 1)} for k in range(n)]
            doc, optional = {"table": f"u_{rng.pick(_NOUNS)}", "label": "Table", "super_class": rng.pick(["task", None]), "fields": rows}, ("default_value", "dependent_on")
        elif tool == "query_table":
            rows = [{"sys_id": rng.hex(32), "number": f"INC{10000 + k}", "short_description": f"{rng.pick(_NOUNS)} failed", "state": rng.pick(["New", "On Hold", "Closed"]), "priority": rng.pick(["1", "2", "3"]), "reopen_count": rng.int(0, 3), "business_duration_min": rng.int(5, 9000)} for k in range(n)]
            doc, optional = {"table": "incident", "records": rows}, ("close_code", "parent_incident")
        elif tool == "list_instances":
            rows = [{"id": f"vm-{rng.hex(6)}{k}", "name": f"{rng.pick(_NOUNS)}-{k}", "status": rng.pick(["running", "stopped", "pending"]), "region": rng.pick(["eu-west", "us-east"]), "cpu": rng.pick([2, 4, 8]), "uptime_hours": rng.int(0, 20000), "monitored": rng.int(0, 4) != 0} for k in range(n)]
            doc, optional = {"items": rows, "next_cursor": rng.hex(16)}, ("last_error", "maintenance_window")
        else:
            rows = [{"event_id": f"evt_{rng.hex(8)}{k}", "actor": f"svc-{rng.pick(_NOUNS)}", "action": rng.pick(["create", "update", "delete"]), "status_code": rng.pick([200, 201, 403, 500]), "latency_ms": rng.int(3, 4000)} for k in range(n)]
            doc, optional = {"result": {"page": 1, "events": rows}}, ("error_message", "retry_of")
        for name in optional:
            for row in rng.shuffle(rows)[: rng.int(1, 4)]:
                row[name] = rng.pick(_NOUNS)
        pretty = tool in ("describe_table", "list_instances")
        out.append((f"D{i + 1:02d}", tool, json.dumps(doc, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":")) + "\n"))
    return out


def summary_markdown(cells: list, pairs: list) -> str:
    """The summary of collected accuracy and paired rows, for a reader."""
    lines = ["| model | rendering | kind | correct | total | share |", "|---|---|---|---|---|---|"]
    lines += [f"| {r['model']} | {r['rendering']} | {r['kind']} | {r['correct']} | {r['total']} | {100 * r['correct'] / r['total']:.1f} % |" for r in cells]
    lines += ["", "| model | both | only first | only second | neither | p |", "|---|---|---|---|---|---|"]
    lines += [f"| {r['model']} | {r['both']} | {r['only_first']} | {r['only_second']} | {r['neither']} | {r['p']:.4f} |" for r in pairs]
    return "\n".join(lines) + "\n"


def write_run(path: str, docs: DataFrame, questions: DataFrame, calls: DataFrame, grades: DataFrame) -> str:
    """A run as Parquet tables in a folder (inputs, questions, calls, grades, summary, pairs); its summary for a reader.

    The summary's tables have a row a model, rendering and kind, so they are small whatever the run.
    """
    for name, df in {"inputs": docs, "questions": questions, "calls": calls, "grades": grades}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    read = docs.sparkSession.read.parquet
    done = read(f"{path}/grades")
    cells = accuracy(done)
    cells.write.mode("overwrite").parquet(f"{path}/summary")
    renderings = [r["rendering"] for r in done.select("rendering").distinct().orderBy("rendering").limit(3).collect()]
    pairs = []
    if len(renderings) == 2:
        paired(done, *renderings).write.mode("overwrite").parquet(f"{path}/pairs")
        pairs = read(f"{path}/pairs").orderBy("model").collect()
    return summary_markdown(read(f"{path}/summary").orderBy("model", "rendering", "kind").collect(), pairs)
