"""Near copies: embeddings and documents against brute force, with edge cases."""

import math
import random

import numpy as np
import pytest

from loomwright.llm import jaccard_join as J
from loomwright.llm.embedding_dedup import near_vectors
from loomwright.llm.graph import connected_components


def components(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 1), (20, 21), (22, 21), (30, 30), (None, 4), *((100, i) for i in range(101, 140)), (139, 138)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 6: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, 22: 20} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_path_of_components(spark):
    ids = list(range(60))
    random.Random(3).shuffle(ids)
    got = connected_components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "u long, v long")).collect()
    assert {r["component"] for r in got} == {0} and len(got) == 60


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for centre in rng.standard_normal((12, 24)):
        for _ in range(rng.integers(1, 14)):
            rows.append((centre + rng.standard_normal(24) * rng.choice([0.02, 0.2, 0.35])).tolist())
    rows += [rows[0], rows[0], [x * 1e-30 for x in rows[1]], [x * 1e200 for x in rows[1]]]
    table = [(i, v, "x") for i, v in enumerate(rows)]
    odd = [(1000, None, "x"), (1001, [0.0] * 24, "x"), (1002, [float("nan")] * 24, "x"), (1003, [float("inf")] + [1.0] * 23, "x"), (1004, [None] + [1.0] * 23, "x"), (1005, [], "x"), (1006, rows[0][:7], "x"), (None, rows[0], "x"), (0, rows[0], "x")]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, id string")).collect()}
    unit = np.array([np.array(v) / np.abs(v).max() for v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    cos = unit @ unit.T
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if cos[i, j] >= 0.9]
    want = components(range(len(rows)), edges)
    links = {i: sum(i in e for e in edges) for i in range(len(rows))}
    assert len(got) == len(rows) + 7
    missed = sum(abs(got[i]["n_links"] - links[i]) for i in links)
    assert missed <= 0.02 * sum(links.values())
    assert sum(got[i]["component_id"] != want[i] for i in links) <= 1
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(1000, 1007))


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    x, y = shingles(a or ""), shingles(b or "")
    return len(x & y) / len(x | y) if x and y else 0.0


def test_documents_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(10):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 16)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    # a group of variants that are near to their base and further from one another
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(40):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += ["a b", "a b", "a  B\n", "", None, "  ", "a b c d e", "a b c d e f", "x" * 50_000, "x" * 50_000]
    rows = [(i, t, "s", i) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in J.near_documents(spark.createDataFrame([*rows, rows[0], (None, "a b", "s", 1)], "doc_id long, text string, source string, id int")).collect()}
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    want = components(range(len(texts)), edges)
    links = {i: sum(i in e for e in edges) for i in want}
    assert len(got) == len(texts)
    wrong = [i for i in links if got[i]["n_links"] != links[i]]
    assert sum(abs(got[i]["n_links"] - links[i]) for i in wrong) <= 0.005 * sum(links.values())
    assert {i: got[i]["class_id"] for i in want} == want
    assert got[texts.index("a b")]["n_copies"] == 3


def test_no_documents(spark):
    assert J.near_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bayesian_pruning():
    for threshold in (0.8, 0.6):
        for n, least in zip(range(J.STEP, J.VALUES + 1, J.STEP), J.least_equal(threshold, 1e-4), strict=True):
            tail = lambda m: sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))  # noqa: B023, E731
            assert tail(least) >= 1e-4 and (least == 0 or tail(least - 1) < 1e-4)
    same = np.zeros(J.VALUES, np.uint32).tobytes()
    assert J.may_reach(same, same, 0.8, 1e-4)
    assert not J.may_reach(same, np.ones(J.VALUES, np.uint32).tobytes(), 0.8, 1e-4)


def test_minhash_estimates_similarity():
    rng = random.Random(1)
    words = [rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(400)]
    other = words[:300] + [w + "x" for w in words[300:]]
    equal = (J.signature(words) == J.signature(other)).mean()
    assert equal == pytest.approx(jaccard(" ".join(words), " ".join(other)), abs=0.12)


def test_pairs_just_above_the_threshold_are_found(spark):
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, dim = 500, 64
    a = unit(rng.standard_normal((n, dim)))
    aside = rng.standard_normal((n, dim))
    aside = unit(aside - (aside * a).sum(axis=1, keepdims=True) * a)
    cos = rng.uniform(0.9, 0.92, n)[:, None]
    b = cos * a + np.sqrt(1 - cos**2) * aside
    rows = [(2 * i, a[i].tolist()) for i in range(n)] + [(2 * i + 1, b[i].tolist()) for i in range(n)]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    every = np.vstack([a, b])
    near = every @ every.T >= 0.9
    found = sum(got[2 * i + 1]["component_id"] == 2 * i for i in range(n))
    assert found >= 0.96 * n
    assert sum(r["n_links"] for r in got.values()) <= near.sum() - 2 * n  # none below the threshold


def test_hashing_grows_slower_than_its_pairs():
    from loomwright.llm.embedding_dedup import collision, hashing

    last = None
    for n in (16, 1000, 10**5, 10**7, 10**9):
        tables, hashes, width = hashing(n, 0.9, 0.985, 0.25)
        assert n * collision(math.sqrt(2), width) ** hashes <= 0.2501
        assert 1 - (1 - collision(math.sqrt(0.2), width) ** hashes) ** tables >= 0.985
        if last:
            assert tables / last[1] <= (n / last[0]) ** 0.35
        last = n, tables
