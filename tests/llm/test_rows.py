"""Exact dedup, mixing, sharding and packing on small tables, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findling.llm import packing, sharding
from findling.llm.exact_dedup import exact_dedup, unique_documents
from findling.llm.mixing import mix_sources, mixed_documents
from findling.llm.queries import op5_shard, word_tokenizer

SF = "/root/testdata/sf0.001"


def test_exact_dedup_with_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 5 + [f"t{j}" for j in range(40)] + [None, ""])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: r for r in exact_dedup(df, keep="largest", carry=["doc_id"], sha="h").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == 3000
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["h"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(20,2)", "string", "date", "double", "binary"])
def test_exact_dedup_identifiers(spark, kind):
    value = "date_add(DATE'2024-01-01', id::int)" if kind == "date" else "encode(id::string, 'UTF-8')" if kind == "binary" else f"id::{kind}"
    df = spark.range(40).selectExpr(f"{value} AS doc_id", "concat('t', id % 7) AS text", "id")
    rows = exact_dedup(df).collect()
    least = {t: min(r["doc_id"] for r in rows if r["text"] == t) for t in {r["text"] for r in rows}}
    assert len(rows) == 40 and all(r["keep_id"] == least[r["text"]] and r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows)
    assert {r["doc_id"] if kind != "binary" else bytes(r["doc_id"]) for r in unique_documents(df).collect()} == {v if kind != "binary" else bytes(v) for v in least.values()}


def test_exact_dedup_odd(odd, empty):
    rows = exact_dedup(odd.drop("kept", "size")).collect()
    assert len(rows) == odd.count()
    assert sum(r["kept"] for r in rows) == 6
    assert {r["keep_id"] for r in rows if r["doc_id"] in (1, 2, None)} == {1}
    assert {r["keep_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert unique_documents(odd).count() == 6 and unique_documents(odd).columns == odd.columns
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_normalises(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a  B")], "doc_id long, text string")
    norm = lambda t: F.lower(F.regexp_replace(t, r"\s+", " "))
    assert {r["keep_id"] for r in exact_dedup(df, normalise=norm).collect()} == {1}


def level_targets(sizes, weights, total):
    """Excess reshared by weight until no target is above its cap."""
    capped = {}
    while True:
        rest = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest} if rest else {}
        over = [s for s in rest if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_targets_and_budgets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["hot"] * 9 + ["b", "c", None, "é", "z"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = level_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()))
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in order:
        assert abs(taken[s] - want[s]) < 1
    again = {r["doc_id"]: r["taken"] for r in mix_sources(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    copies = mixed_documents(df)
    assert copies.columns == df.columns
    assert copies.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))))).first()[0] == sum(taken.values())


def test_mixing_odd(odd, empty):
    got = mix_sources(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert mixed_documents(odd).columns == odd.columns
    assert {r["size"] for r in mixed_documents(odd).select("size").collect()} == {"mine"}
    assert mix_sources(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_matrix_has_exact_margins_and_fair_means():
    rows, cells = [50, 0, 31, 19], [25, 25, 50]
    total = np.zeros((4, 3))
    for seed in range(300):
        m = np.array(list(sharding.draw_rows(iter(rows), cells, seed)))
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == cells
        total += m
    assert np.abs(total / 300 - np.outer(rows, cells) / 100).max() < 0.6


def test_large_totals_are_drawn_too(monkeypatch):
    rng = np.random.default_rng(0)
    draws = [sharding._hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(draws) - 750) < 3 and 8 < np.std(draws) < 20
    small = Counter(sharding._hypergeometric(rng, 3, 5, 4) for _ in range(20_000))
    chance = {k: math.comb(3, k) * math.comb(5, 4 - k) / math.comb(8, 4) for k in range(4)}
    assert all(abs(small[k] / 20_000 - c) < 0.015 for k, c in chance.items()) and sum(small.values()) == 20_000
    monkeypatch.setattr(sharding, "MOST_DRAWN", 0)
    m = np.array(list(sharding.draw_rows(iter([40, 0, 60]), [34, 33, 33], 5)))
    assert m.sum(axis=1).tolist() == [40, 0, 60] and m.sum(axis=0).tolist() == [34, 33, 33]
    with pytest.raises(ValueError):
        list(sharding.draw_rows(iter([2]), [1], 0))


def check_shards(rows, n):
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    sizes = [len(per.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1


def test_shards(spark, odd, empty):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")).repartition(6)
    got = sharding.shuffle_into_shards(df, 24, cell_bytes=500)
    rows = got.collect()
    check_shards(rows, 24)
    assert sorted(r["doc_id"] for r in rows) == list(range(5000))
    # Neighbours of the input are not neighbours of the output.
    near = [abs(a["doc_id"] - b["doc_id"]) for a, b in zip(sorted(rows, key=lambda r: (r["shard"], r["slot"])), sorted(rows, key=lambda r: (r["shard"], r["slot"]))[1:], strict=False)]
    assert np.mean(near) > 1200
    odd_rows = sharding.shuffle_into_shards(odd, 3).collect()
    check_shards(odd_rows, 3)
    assert len(odd_rows) == odd.count() and odd_rows[0]["kept"] == "mine"
    assert sharding.shuffle_into_shards(empty, 3).count() == 0


def test_shard_query(spark):
    rows = op5_shard(spark, SF).collect()
    check_shards(rows, 24)
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]]), "rows", None)


def test_shuffle_is_uniform(spark):
    """Over many seeds each row comes to each shard about equally often, and rows of one partition are not kept together."""
    df = spark.range(24).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(3).cache()
    seen, together = np.zeros((24, 3)), 0
    for seed in range(12):
        shard = {r["doc_id"]: r["shard"] for r in sharding.shuffle_into_shards(df, 3, seed).collect()}
        together += shard[0] == shard[1]
        for i, s in shard.items():
            seen[i, s] += 1
    assert np.abs(seen / 12 - 1 / 3).max() < 0.6 and together <= 9


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
@settings(max_examples=150, deadline=None)
def test_histogram_packing(histogram):
    patterns = packing.pack_histogram(histogram, 64)
    held = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 64 and count > 0 and lengths == sorted(lengths, reverse=True)
        for n in lengths:
            held[n] += count
    assert held == Counter(histogram)


def test_histogram_packing_is_tight_and_strict():
    rng = np.random.default_rng(5)
    h = Counter((rng.lognormal(4, 1, 20_000).astype(int) % 512 + 1).tolist())
    packs = sum(c for _, c in packing.pack_histogram(h, 512))
    assert packs <= 1.03 * sum(n * c for n, c in h.items()) / 512 + 1
    with pytest.raises(ValueError):
        packing.pack_histogram({513: 1}, 512)


def test_packing_keeps_every_token(spark, odd, empty):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.filter("doc_id > 4").select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    strange = spark.createDataFrame([(900_001, "<|STARTOFTEXT|> a<|startoftext|>b <|endoftext|>"), (900_002, "I'm it's É\u0301 x\x1c\x85y\u00a0z İ ΣΑΣ Don'T end's."), (900_003, None)], "doc_id long, text string")
    docs = docs.unionByName(strange)
    pieces = packing.tokenise_pieces(docs, word_tokenizer(), 256)
    rows = packing.pack_pieces(pieces, 256).collect()
    tokenizer = Tokenizer.from_file(word_tokenizer())
    own = defaultdict(list)
    place = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in docs.collect():
        want = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        got = sorted(own[r["doc_id"]])
        assert b"".join(b for _, b, _ in got) == want.tobytes() and got[0][2] == len(want)
    for parts in place.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert set(place) == set(range(len(place)))
    assert packing.pack_pieces(packing.tokenise_pieces(empty, word_tokenizer())).count() == 0


def laid_out(rows, capacity):
    """Sequences are numbered from 0 and gapless, and none holds too much."""
    place = defaultdict(list)
    for r in rows:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in place.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert set(place) == set(range(len(place)))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packing_odd(spark, odd, name):
    """Null and repeated identifiers, repeated rows, carried columns of other names, and a tokenizer that keeps white space."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    assert packing._Ids(path).by_word == (name == "word_bpe_49k.json")
    docs = odd.filter("doc_id IS NULL OR doc_id <> 7").withColumn("a.b", F.col("lang")).withColumn("OFFSET", F.lit("mine"))
    pieces = packing.tokenise_pieces(docs, path, 64, carry=("a.b", "size", "OFFSET"))
    assert pieces.columns == ["doc_id", "a.b", "size", "OFFSET", "start", "length", "doc_tokens", "ids"]
    packed = packing.pack_pieces(pieces, 64)
    assert packed.columns == [c for c in pieces.columns if c != "OFFSET"] + ["sequence_id", "offset"]
    rows = packed.collect()
    laid_out(rows, 64)
    encode = Tokenizer.from_file(path).encode
    want = []
    for r in docs.collect():
        ids = [*encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want += [(r["doc_id"], r["a.b"], r["size"], a, len(ids), ids[a : a + 64]) for a in range(0, len(ids), 64)]
    got = [(r["doc_id"], r["a.b"], r["size"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        packing.tokenise_pieces(docs.withColumn("Start", F.lit(1)), path, carry=("Start",))


def test_long_words_are_not_remembered():
    """Texts without spaces: ids equal those of whole texts, nothing long is kept, and 20 MB stay within bounds."""
    import subprocess
    import sys

    from tokenizers import Tokenizer

    path = word_tokenizer()
    rng = random.Random(5)
    encode, whole = packing._Ids(path), Tokenizer.from_file(path)
    chinese = "".join(rng.choice("\u4e2d\u6587\u5b57\u6f22\u7684\u3002\uff0c1a") for _ in range(90_000))
    code = "".join(rng.choice("abcXYZ019(){};=+/'s") for _ in range(120_000))
    texts = [chinese, code, f"short words {code[:90]} again", "1" * 70_000, ""]
    assert encode.cuts
    for got, text in zip(encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert max(map(len, encode.words.new)) <= 64
    work = f"""
import resource, random
from findling.llm import packing
e = packing._Ids({path!r})
low = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = "".join(random.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=200_000)) * 100
assert len(e([text])[0]) > 4_000_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - low) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", work], capture_output=True, text=True, check=True, timeout=200).stdout)
    assert grown < 500
