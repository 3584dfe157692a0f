"""The pipeline and the registered queries on a small fixture, against a plain version of each stage."""

import collections

import corpus_pipeline as P
import pytest

import __spark_entry__ as entry
from loomwright.llm import jaccard_join, language_id, pii


@pytest.fixture(scope="module")
def docs_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    words = {"en": "the and of to in that with for on is was by".split(), "de": "der die und ein mit von auf ist nicht auch zu im".split()}
    import random

    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        text = " ".join(rng.choice(words[lang]) + str(rng.randint(0, 99)) * (k % 5 == 0) for k in range(rng.randint(20, 150)))
        rows.append((i, text, None if i % 13 == 0 else lang, f"src{i % 4}", len(text)))
    rows += [(300 + k, rows[3][1], "de", "src1", 1) for k in range(5)] + [(310, "12 34", "en", "src0", 5), (311, None, "en", "src0", None), (312, rows[8][1] + " mail a@b.com 4111111111111111", "en", None, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, docs_dir):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    whole = {r["doc_id"]: r for r in docs.collect()}
    assert [name for name, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "pii", "mixing", "packing"]
    out, frames = docs, {}
    for name, stage in P.STAGES:
        before = out
        out = stage(spark, before, docs_dir)
        if name != "packing":
            assert tuple(out.columns) == P.COLUMNS
        frames[name] = (before, out)
    told = {r["doc_id"]: r for r in frames["language_id"][1].collect()}
    assert set(told) == {i for i, r in whole.items() if language_id.has_letter(r["text"])}
    assert all(told[i]["lang"] == whole[i]["lang"] or whole[i]["lang"] is None for i in told) and all(r["lang"] for r in told.values())
    kept = {r["doc_id"] for r in frames["ngram_jaccard_join"][1].collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    ids = sorted(told)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            x, y = shingles(told[a]["text"]), shingles(told[b]["text"])
            if a < b and len(x & y) >= 0.8 * len(x | y):
                root[b] = min(root[b], root[a])
    assert kept == {i for i in ids if root[i] == i}
    clean = {r["doc_id"]: r for r in frames["pii"][1].collect()}
    assert set(clean) == kept
    for i, r in clean.items():
        base = pii.base_spans(told[i]["text"])
        assert r["text"] == pii.redact(told[i]["text"], base) and (not base or r["n_chars"] == len(r["text"]))
    taken = collections.Counter()
    for r in frames["mixing"][1].collect():
        assert clean[r["doc_id"]]["text"].startswith(r["text"])
        taken[r["source"]] += len(r["text"].split())
    have = collections.Counter()
    for r in clean.values():
        have[r["source"]] += len(r["text"].split())
    from loomwright.llm import mixing

    order = sorted(have, key=lambda s: (s is None, s or ""))
    want = mixing.targets([have[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    assert [taken[s] for s in order] == pytest.approx(want, abs=1)
    pieces = frames["packing"][1].collect()
    assert sum(r["length"] for r in pieces if r["start"] == 0) and all(r["offset"] + r["length"] <= 1024 for r in pieces)


def test_run_and_registration(spark, docs_dir):
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    packed = names["pipeline"](spark, docs_dir)
    assert packed.count() > 0
    assert jaccard_join.near_documents(spark.read.parquet(f"{docs_dir}/documents.parquet")).count() == 248


def test_mixing_takes_what_the_shards_draw(spark, docs_dir, monkeypatch):
    from loomwright.llm import mixing

    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    mixed = {r["id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = {r["doc_id"]: r["taken"] for r in entry.queries()["op6_mixing"](spark, docs_dir).collect()}
    assert got == mixed and len(got) == 248 and 0 in got.values()
    every = mixing.shards
    some = collections.Counter()
    for r in mixing.copies(mixing.mix(docs)).where("shard < 20").collect():
        some[r["id"]] += r["words"]
    monkeypatch.setattr(mixing, "shards", lambda *a: every(*a).where("shard < 20"))
    got = {r["doc_id"]: r["taken"] for r in entry.queries()["op6_mixing"](spark, docs_dir).collect()}
    assert got == {i: some[i] for i in mixed} and 0 < sum(got.values()) < sum(mixed.values())


def test_mixing_writes_shuffled_shards(spark, docs_dir, tmp_path):
    import pyarrow.parquet as pq

    from loomwright.llm import mixing

    docs = spark.read.parquet(f"{docs_dir}/documents.parquet").where("text is not null").dropDuplicates(["text"])
    P.mixture(spark, docs, docs_dir).write.parquet(f"{tmp_path}/mixed")
    shards = collections.defaultdict(list)
    for r in mixing.copies(mixing.mix(docs)).collect():
        shards[r["shard"]].append((r["place"], r["id"], r["words"]))
    want = [[(i, n) for _, i, n in sorted(shards[k])] for k in sorted(shards)]
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    got = [[(i, len(t.split())) for i, t in zip(x["doc_id"].to_pylist(), x["text"].to_pylist(), strict=True)] for x in map(pq.read_table, files)]
    assert [x for x in got if x] == want and len(want) > 32
    assert any(x != sorted(x) for x in want)


def test_stages_with_odd_rows(spark):
    """Repeated rows, ids that repeat or are null, null columns, columns with clashing names, a very long text, an empty table."""
    import random

    rng = random.Random(9)
    prose = lambda k: " ".join(rng.choice("the and of to in that with for on is was by".split()) + str(rng.randint(0, 99)) for _ in range(k))
    one, two, three = prose(60), prose(60), prose(20_000)
    rows = [(7, one), (7, one), (7, two), (3, two), (None, one), (None, prose(40)), (1, three), (1, three), (9, None), (10, ""), (11, "12 34"), (None, None), *((100 + i, prose(50)) for i in range(40))]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 4}", None, 5, "x", "y") for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int, class_id string, size string"
    docs = spark.createDataFrame(rows, schema)
    out = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert name == "packing" or tuple(docs.columns) == P.COLUMNS
        out[name] = docs.collect()
    assert len(out["language_id"]) == len(rows) - 4 and {r["lang"] for r in out["language_id"]} == {"en"}
    # one row of each group stays, of the smallest id, an id before none
    kept = [(r["doc_id"], r["text"]) for r in out["ngram_jaccard_join"]]
    assert len(kept) == 40 + 4 and {(7, one), (3, two), (1, three)} <= set(kept) and sum(i is None for i, _ in kept) == 1
    assert sorted(map(str, kept)) == sorted(str((r["doc_id"], r["text"])) for r in out["pii"])
    length = {r["doc_id"]: 0 for r in out["mixing"]}
    for r in out["mixing"]:
        length[r["doc_id"]] += len(r["text"].split())
    assert sum(length.values()) == pytest.approx(sum(len(t.split()) for _, t in kept), abs=6)
    pieces = out["packing"]
    assert {r["doc_id"] for r in pieces} == set(length) and len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    empty = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").collect() == []
