"""Prefix tries, exact search and whitening against plain versions on small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findling.llm import list_ranking, prefix_trie, topk_search
from findling.llm.bidiagonal import bidiagonalised, dqds, right_vectors
from findling.llm.list_ranking import contracted, list_rank
from findling.llm.prefix_trie import numbered_turns, with_shared_beginnings
from findling.llm.topk_search import Bucket, top_products
from findling.llm.whitening import merged_moments, whiten


def naive_trie(rows):
    """(conv, turn, role, text) -> node rows by a plain walk over all prefixes."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0, mark), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = set()
    for k, cs in members.items():
        under = [j for j in members if j[: len(k)] == k]
        saved = sum((len(members[j]) - 1) * len(j[-1][1].split()) for j in under if j)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.add((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children[k]), sum(not children[j] for j in under), saved, sha))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def spark_trie(df, block=list_ranking.BLOCK):
    return [tuple(r[c] for c in NODE) for r in prefix_trie.prefix_trie(*with_shared_beginnings(numbered_turns(df)), block).collect()]


def some_turns(rng, convs=50, most=7):
    rows = []
    for c in rng.sample(range(-25, 90), convs):
        for t in range(rng.randrange(0, most)):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "c", "a b c\td", "", None])))
    return rows


@pytest.mark.parametrize("block", [list_ranking.BLOCK, 9])
def test_trie_against_a_walk(spark, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    monkeypatch.setattr(prefix_trie, "JOINED", 2)
    rows = some_turns(random.Random(block))
    rows += rows[:3] + [(None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns({"depth": F.lit("own"), "node": F.lit(1), "conv": F.lit("x"), "N": F.lit(2)})
    got = spark_trie(df, block)
    assert len(got) == len(set(got)) and set(got) == naive_trie(rows)


def test_trie_of_a_hot_conversation(spark, monkeypatch):
    """One conversation in many copies, and one that holds a third of all turns."""
    monkeypatch.setattr(prefix_trie, "SPAN", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 300) for t in range(3)]
    rows += [(1000, t, "user", f"step {t % 5}") for t in range(450)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert set(spark_trie(df, 50)) == naive_trie(rows)


def test_trie_places_nest(spark):
    df = spark.createDataFrame(some_turns(random.Random(3)), "conv_id long, turn long, role string, text string")
    rows = prefix_trie.prefix_trie(*with_shared_beginnings(numbered_turns(df))).collect()
    assert sorted(x for r in rows for x in (r["enter"], r["leave"])) == list(range(2 * len(rows)))
    at = {(r["conv_id"], r["depth"]): r for r in rows}
    for r in rows:
        if r["depth"]:
            up = at[r["parent_conv_id"], r["depth"] - 1]
            assert up["enter"] < r["enter"] < r["leave"] < up["leave"]


def test_trie_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert spark_trie(df) == []
    assert spark_trie(spark.createDataFrame([(5, None, None, None)], df.schema)) in ([(5, 0, None, 1, 1, 1, 0, hashlib.sha256(b"").hexdigest()), (5, 1, 5, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())], [(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())])


@pytest.mark.parametrize("block", [4, 1000])
def test_lists_are_ranked(spark, block):
    rng = random.Random(block)
    ids = rng.sample(range(500), 200)
    lists, rows, want = [ids[:150], ids[150:199], ids[199:]], [], {}
    for one in lists:
        at = [0, 0]
        for i, j in zip(one, [*one[1:], None], strict=True):
            w = (rng.randrange(-5, 9), 1)
            rows.append((i, j, *w))
            want[i] = tuple(at)
            at = [at[0] + w[0], at[1] + w[1]]
    got = list_rank(spark.createDataFrame(rows, "id long, next long, a long, b long"), ["a", "b"], block).collect()
    assert {r["id"]: (r["a"], r["b"]) for r in got} == want and len(got) == 200


def test_chains_contract():
    ids, after = np.array([2, 5, 7, 9, 11]), np.array([7, 100, 11, -1, 5])
    head, off, onward, total = contracted(ids, after, np.array([[1, 2, 4, 8, 16]]))
    assert head.tolist() == [0, 0, 0, 3, 0] and off.tolist() == [[0, 21, 1, 0, 5]]
    assert onward[[0, 3]].tolist() == [100, -1] and total[0, [0, 3]].tolist() == [23, 8]


def naive_search(rows, k, asked):
    good = [(i, x, v) for i, (x, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, q, v in good:
        if asked(q):
            scores = sorted((-int(np.dot(v, w)), x is None, x or 0) for j, x, w in good if j != i and len(w) == len(v))
            out += [(q, n + 1, None if none else x, -s) for n, (s, none, x) in enumerate(scores[:k])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("kind", ["long and short", "alike", "clustered"])
def test_search_against_all_products(spark, kind, monkeypatch):
    for name, value in {"CANDIDATES": 40, "QUERIES": 7, "LONGEST": 25}.items():
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(len(kind))
    v = rng.normal(size=(400, 6))
    if kind == "long and short":
        v *= np.exp(rng.normal(size=(400, 1)) * 2)
    if kind == "clustered":
        v = rng.normal(size=(9, 6))[rng.integers(9, size=400)] + 0.05 * v
    v = np.floor(v * 50)
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    rows += [(i % 7, v[3].tolist()) for i in range(150)] + [(None, v[3].tolist()), (None, [0.0] * 6), (1000, [0.0] * 6), (10, v[10].tolist()), (10, v[10].tolist())]
    rows += [(50, None), (60, []), (70, [float("nan")] * 6), (80, [None] * 6), (90, [float("inf")] * 6), (100, [1.0, 2.0]), (110, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6).withColumns({"row": F.lit("own"), "cls": F.lit(1), "Level": F.lit(2)})
    got = sorted(repr(tuple(r)) for r in top_products(df, 3, F.col("vec_id") % 10 == 0).collect())
    assert got == naive_search(rows, 3, lambda q: q is not None and q % 10 == 0)
    assert top_products(df.limit(0), 3).count() == 0


def test_buckets_look_up_coordinates():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20, 16))[rng.integers(20, size=3000)] + 0.1 * rng.normal(size=(3000, 16))
    v = np.floor(v * (1000 / np.linalg.norm(v, axis=1))[:, None])
    bucket = Bucket(v, np.arange(3000), np.arange(3000))
    q = v[:40]
    scores = v @ q.T
    best = np.sort(scores, axis=0)[::-1][:4]
    found = bucket.search(q, best[3].astype(float), 4)
    assert bucket.looked_up == 40 and bucket.verified < 40 * 3000 / 4
    assert all(np.array_equal(s, best[:, i]) for i, (_, s) in enumerate(found))


def test_white_against_eigenvectors(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(1, v[0].tolist())] * 90 + [(None, v[5].tolist())]
    bad = [(2, None), (3, [None] * 12), (4, [float("nan")] * 12), (5, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(40).withColumns({"X": F.lit("own"), "id": F.lit("own"), "White": F.lit(1)})
    got = whiten(df, 5).collect()
    x = np.floor(np.array([r for _, r in rows]).astype(float) * 1024).astype(np.int64) + 100_000
    n = len(x)
    y = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = y @ vectors[:, :5] / np.sqrt(values[:5])
    assert len(got) == n
    assert sorted(r["deviation"] for r in got) == sorted(((n * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist())
    assert np.allclose(np.sort(np.abs([r["white"] for r in got]), axis=0), np.sort(np.abs(white), axis=0), atol=1e-9)
    one = got[0]
    assert one["n"] == n and np.allclose(one["explained"], values[:5] / values.sum(), rtol=1e-12) and one["identity_error"] < 1e-10


def test_white_odd(spark):
    kind = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r["n"], r["deviation"], r["white"], r["identity_error"]) for r in one] == [(1, 0, [], None)]
    same = whiten(spark.createDataFrame([(i, [0.5, 2.0]) for i in range(9)], kind)).collect()
    assert len(same) == 9 and all(r["white"] == [] for r in same)
    short = whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 3.0]), (3, [2.0, 1.0]), (4, [])], kind)).collect()
    assert len(short) == 4 and all(len(r["white"]) == 2 and r["identity_error"] < 1e-10 for r in short)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 2**32), st.sampled_from(["full", "graded", "zeros", "ties"]))
def test_singular_values_and_vectors(d, seed, kind):
    rng = np.random.default_rng(seed)
    r = np.triu(rng.normal(size=(d, d)))
    if kind == "graded":
        r *= np.logspace(0, -5, d)[:, None]
    if kind == "zeros":
        r[:, rng.random(d) < 0.4] = 0
    if kind == "ties":
        r = np.diag(rng.choice([1.0, 2.0], d))
    b, f, v = bidiagonalised(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-12)
    assert np.allclose(dqds(b**2, f**2), want, rtol=1e-9, atol=1e-13 * want.max(initial=0))
    squares, vectors = right_vectors(r, 4)
    assert len(squares) == min(4, (want > 1e-24 * want[0]).sum()) or kind == "zeros"
    assert np.allclose(vectors.T @ vectors, np.eye(len(squares)), atol=1e-8)
    assert np.allclose(r.T @ (r @ vectors), vectors * squares, atol=1e-9 * max(want[0], 1e-300))


def test_moments_merge():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(50, 3)) + 1e6
    parts = [np.concatenate([[len(p)], p.mean(axis=0), ((p - p.mean(axis=0)).T @ (p - p.mean(axis=0))).ravel()]) for p in (w[:7], w[7:8], w[8:])]
    got = merged_moments(parts)
    assert np.allclose(got[4:].reshape(3, 3) / 50, np.cov(w.T, bias=True), rtol=1e-6)
