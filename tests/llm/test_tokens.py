"""Mixing, packing, token files and top-k search against plain Python."""

import collections
import zlib

import numpy as np
import pytest

from loomwright.llm import dac, mixing, packing, topk
from loomwright.llm.common import new_path
from loomwright.llm.queries import vocabulary
from loomwright.llm.tokens import Encoder

ODD = ["a  b", " a", "a ", "", "x \n y", "\n y z", "\nfoo bar", "a\n b", " <|endoftext|> a", "é è   x y　z", None, "a " * 50 + "b", "don't stop'll", "w" * 3000, "日本語 テキスト", "\x1c a \x85 b"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary())


#: What texts of the test below are drawn from: every kind of character that the places of cuts look at.
ATOMS = [*"abÉéß×÷яЖ²½ªº日 01.,;-()$'\"_\n\t\r\x0b\x85\xa0\u2003\u3000“”’\0\x1c", *[" "] * 6, *["\n"] * 3, "'s", "'re", "n't", "word", "<|endoftext|>", "long" * 9]


def test_pieces_equal_whole_texts(encoder, monkeypatch):
    import random

    from tokenizers import Tokenizer

    from loomwright.llm import tokens

    plain, rng = Tokenizer.from_file(vocabulary()), random.Random(1)
    texts = ODD + ["".join(rng.choices(ATOMS, k=rng.randint(0, 60))) for _ in range(3000)] + [" ", "\n", "a\n", "\na", " \n a"]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    # a table that fills up, and texts in many parts
    monkeypatch.setattr(tokens, "FULL", 300)
    monkeypatch.setattr(tokens, "SPAN", 64)
    narrow = Encoder(vocabulary())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in narrow.encode(texts)] == want
    assert 0 < narrow.held <= 300


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1], 3) == pytest.approx([18.75, 7.5, 3.75])
    got = mixing.targets([1, 100, 100], [5, 2, 1], 3)
    assert got[0] == 3 and sum(got) == pytest.approx(201) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([0, 5], [5, 2], 3) == [0, 5] and mixing.targets([], [], 3) == []


def test_split_quotas():
    q = np.array([100, 0, 7, 33])
    got = mixing.split_quotas(q, 5, 1)
    assert (got.sum(axis=0) == q).all() and (got >= 0).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 2
    assert (got == mixing.split_quotas(q, 5, 1)).all()
    assert mixing.split_quotas(np.array([], np.int64), 3, 1).shape == (3, 0)


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), ["b", "a", None, "é", "hot"][min(4, int(rng.integers(0, 9)))], 1) for i in range(700)]
    rows += [(900, None, "a", 1), (901, " \t\x0b", "a", 1), (None, "x y", "b", 1), (0, rows[0][1], rows[0][2], 1), (902, "v " * 3000, "hot", 1), (903, "", "void", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert len(got) == len(rows)
    taken, size, target = collections.Counter(), {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    assert [target[s] for s in order] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = sorted((r["id"] is None, r["id"], r["taken"]) for r in mixing.mix(df.repartition(7)).collect())
    assert again == sorted((r["id"] is None, r["id"], r["taken"]) for r in got)
    each = mixing.copies(mixed, 8).collect()
    assert sum(r["words"] for r in each) == sum(r["taken"] for r in got)
    assert {r["shard"] for r in each} <= set(range(8))
    assert mixing.mix(df.limit(0)).collect() == []


def test_mix_against_a_plain_version(spark):
    """Targets by bisection on the water level; shards, blocks and words counted one by one."""
    rng = np.random.default_rng(5)
    sizes = {s: [int(rng.integers(0, 40)) for _ in range(int(n))] for s, n in zip(["a", "b", "ä", "z", "c", None], [3, 900, 200, 60, 400, 30], strict=True)}
    rows = [(s, n) for s, all_ in sizes.items() for n in all_]
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    have = np.array([sum(sizes[s]) for s in order], float)
    weight = np.array([(5, 2, 1)[i % 3] for i in range(len(order))], float)
    low, high = 0.0, have.sum()
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if np.minimum(3 * have, level * weight).sum() < have.sum() else (low, level)
    want = np.minimum(3 * have, low * weight)
    mixed = mixing.mix(df)
    docs = mixed.collect()
    total = collections.Counter()
    for r in docs:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(rows[r["id"]][1].split())
        total[r["source"]] += r["taken"]
    assert [total[s] for s in order] == pytest.approx(want, abs=1)
    quota = {s: 0 for s in order}
    for r in docs:
        if r["taken"]:
            quota[r["source"]] = max(quota[r["source"]], (r["taken"] - 1) // r["size"] * mixing.BLOCKS + r["block"] + 1)
    deals = []
    for seed in (17, 18):
        runs = mixing.shards(mixed, 8, seed).collect()
        for s in order:  # the shards' runs of blocks cover a source's quota, each block once
            mine = sorted((r["first"], r["last"]) for r in runs if r["source"] == s)
            assert [a for a, _ in mine] == [0, *(b for _, b in mine[:-1])] and mine[-1][1] == quota[s]
        copies = mixing.copies(mixed, 8, seed).collect()
        words = collections.Counter()
        for r in copies:
            words[r["id"]] += r["words"]
        assert words == {r["id"]: r["taken"] for r in docs if r["taken"]}
        per = collections.Counter(r["shard"] for r in copies)
        assert len(per) == 8 and max(per.values()) < 2 * min(per.values())
        deals.append({(r["id"], r["copy"]): r["shard"] for r in copies})
    assert deals[0].keys() == deals[1].keys() and deals[0] != deals[1]


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {1023: 5}, {700: 5000, 324: 10}, {512: 7}, {k: 3 for k in range(1, 1024)}, {300: 1001, 5: 3}])
def test_plan(histogram):
    plan = packing.plan(histogram)
    room = collections.defaultdict(list)
    covered = collections.defaultdict(list)
    for length, first, end, start, stop, base, offset in plan.slots:
        for k in range(end - first):
            room[base + k].append((offset, stop - start))
            covered[length, first + k].append((start, stop))
    assert set(covered) == {(length, k) for length, n in histogram.items() for k in range(n)}
    for (length, _), parts in covered.items():
        at = 0
        for start, stop in sorted(parts):
            assert start == at and stop > start
            at = stop
        assert at == length
    assert set(room) == set(range(plan.sequences))
    for parts in room.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    tokens = sum(k * n for k, n in histogram.items())
    assert plan.sequences <= -(-tokens // 1024) * 1.02 + 2


def test_pack(spark, encoder):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gamma.\n", "x1"], int(rng.integers(0, 900)))) for _ in range(120)] + ["same text"] * 80 + ODD
    rows = [(i % 190, t, "s") for i, t in enumerate(texts)] + [(None, "no id", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = packing.pack(df, vocabulary()).collect()
    ids = collections.Counter()
    for (i, _, _), x in zip(rows, encoder.encode([t for _, t, _ in rows]), strict=True):
        ids[i, x + b"\0\0\0\0"] += 1
    want = collections.Counter()
    by_doc = collections.defaultdict(list)
    for (i, x), n in ids.items():
        by_doc[i].append(x)
        want[i, len(x) // 4] += n * (len(x) // 4)
    have = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in got:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        crcs = {zlib.crc32(x[4 * r["start"] : 4 * (r["start"] + r["length"])]) for x in by_doc[r["doc_id"]] if len(x) // 4 == r["doc_tokens"]}
        assert r["ids_crc32"] in crcs
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(want.values())
    assert len(sequences) <= -(-total // 1024) + 2
    assert packing.pack(df.limit(0), vocabulary()).collect() == []


def test_segment():
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.where(rng.random(n) < 0.4, rng.integers(0, 256, n), rng.integers(0, 2**32, n)).astype(np.uint32)
        data = dac.encode_segment(ids, [7], [n])
        segment = dac.Segment(data)
        assert (segment.all() == ids).all()
        assert all(segment[i] == ids[i] for i in range(0, n, 7))
        with pytest.raises(IndexError):
            segment[n]
    with pytest.raises(ValueError, match="damaged"):
        dac.Segment(data[:-1] + bytes([data[-1] ^ 1]))


def test_token_files(spark, encoder):
    rows = [(i * 3 % 101, f"text number {i} " * (i % 9), "s") for i in range(101)] + [(200 + i, t, "s") for i, t in enumerate(ODD)] + [(None, "null id", "s"), (5, "again", "s"), (300, "long " * 30_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    path = new_path(spark, "dac")
    dac.write(df, path, vocabulary(), per=700, buckets=5)
    got = sorted(dac.documents(spark, path).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, flat = 0, b""
    for r, (i, t, _) in zip(got, order, strict=True):
        x = encoder.encode([t])[0] + b"\2\0\0\0"
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(x) // 4, zlib.crc32(x))
        at += len(x) // 4
        flat += x
    for place in (0, 1, 500, at - 1):
        assert dac.token_at(spark, path, place) == int.from_bytes(flat[4 * place : 4 * place + 4], "little")
    assert dac.token_at(spark, path, at) is None
    empty = new_path(spark, "dac")
    dac.write(df.limit(0), empty, vocabulary())
    assert dac.documents(spark, empty).collect() == []


def test_search_levels():
    rng = np.random.default_rng(6)
    base = np.repeat(rng.standard_normal((40, 16)) * 20, 4, axis=1)  # smooth: segments tell much
    c = np.floor(np.vstack([b + rng.standard_normal((50, 64)) for b in base]))
    q = np.floor(base[:5] + rng.standard_normal((5, 64)))
    counts = []
    got = topk.search(np.arange(10_000, 10_005), q, np.arange(len(c)), c, 20, counts)
    scores = (q @ c.T).astype(int)
    assert [[i for _, i in best] for best in got] == [[int(i) for i in np.lexsort((np.arange(len(c)), -s))[:20]] for s in scores]
    assert counts[0] >= counts[1] >= counts[2] and counts[2] < 0.5 * scores.size
    # with what a first block found as its threshold, the rest is pruned further and nothing is lost
    half = len(c) // 2
    first = topk.search(np.arange(10_000, 10_005), q, np.arange(half), c[:half], 20)
    rest = topk.search(np.arange(10_000, 10_005), q, np.arange(half, len(c)), c[half:], 20, counts, [best[-1][0] for best in first])
    assert [sorted(((-s, i) for s, i in a + b))[:20] for a, b in zip(first, rest, strict=True)] == [[(-s, i) for s, i in best] for best in got]
    assert counts[0] < 0.5 * scores.size / 2


def test_topk(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(8) * 2).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]
    odd = [(1000, None), (1020, [float("nan")] * 8), (1040, [None] * 8), (1060, [float("inf")] * 8), (1080, []), (None, rows[1][1]), (1100, [1.0, 2.0]), (1120, [1.0, -2.0])]
    big = [(2000, [1e6] * 8), (2020, [-1e12] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd + big], "vec_id long, embedding array<double>, score string")
    from pyspark.sql import functions as F

    got = collections.defaultdict(list)
    for r in topk.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(x * 64)) for x in v] for i, v in rows + odd[6:] + big}
    for q in (i for i in whole if i % 20 == 0):
        want = sorted(((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])))[:20]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]
    assert set(got) == {i for i in whole if i % 20 == 0}
    # a query's id that is repeated asks once, and none of its rows is its own candidate
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.5, 2.0]), (2, [0.5, 2.0])], "vec_id long, embedding array<double>")
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.nearest(twice, F.col("vec_id") == 0).collect()]
    asked = max(topk.quantised(v, 64) for v in ([1.0, 0.0], [0.0, 1.0]))
    scores = sorted(((-int(topk.components(asked) @ topk.components(topk.quantised(v, 64))), i) for i, v in ((1, [1.0, 0.5]), (2, [0.5, 2.0]), (2, [0.5, 2.0]))))
    assert sorted(found) == [(0, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert topk.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_added_tokens_get_their_ids(spark, encoder):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    texts = [*ODD, "end of one<|endoftext|>start of next", "<|endoftext|>", "a, b.\n<|endoftext|>\nc <|endoftext|> d", "<|endoftext", "start of next"]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[len(ODD)].count(plain.token_to_id("<|endoftext|>")) == 1
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == want
    path = new_path(spark, "dac")
    dac.write(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), path, vocabulary())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in dac.documents(spark, path).collect()}
    assert got == {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, ids in enumerate(want)}
