"""The stages of the pipeline, each held against a plain version on its own input."""

import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipe
from findling.llm import mixing, near_dedup, packing, quality_rules
from findling.llm.common import documents
from findling.llm.queries import line_field, word_tokenizer
from findling.storage import written

from .conftest import CLASHES
from .test_rows import laid_out, level_targets
from .test_texts import brute_components

SF = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def whole_ids(text):
    return [*Tokenizer.from_file(word_tokenizer()).encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(docs, rows):
    """Every row of ``docs`` is there once, token by token, under a number of its own, and the layout is gapless."""
    copies = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        copies[r["copy_id"]].append((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    got = []
    for pieces in copies.values():
        pieces.sort(key=lambda p: p[1])
        assert len({d for d, _, _ in pieces}) == 1 and [a for _, a, _ in pieces] == [pipe.SEQUENCE * i for i in range(len(pieces))]
        got.append((pieces[0][0], [i for _, _, ids in pieces for i in ids]))
    assert sorted(got, key=repr) == sorted(((d["doc_id"], whole_ids(d["text"])) for d in docs), key=repr)
    laid_out(rows, pipe.SEQUENCE)


def check_mixing(before, after):
    """Each source's words are its target's, no document is there over three times, and all but one copy of a source are whole."""
    sizes, taken, cut, times = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    text = {r["doc_id"]: r["text"] for r in before}
    for r in before:
        sizes[r["source"]] += words(r["text"])
    for r in after:
        taken[r["source"]] += words(r["text"])
        times[r["doc_id"]] += 1
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        cut[r["source"]] += r["text"] != text[r["doc_id"]]
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    want = level_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) < 1 and cut[s] <= 1 for s in sizes) and max(times.values()) <= 3


def check_quality(spark, docs, before, after):
    field = line_field(spark, docs, SF)
    kept = []
    for r in before:
        n, _, _, _, repeated, content, _ = quality_rules.measure(r["text"], field)
        if n >= 20 and 100 * repeated <= 30 * n and content / n >= quality_rules.LEAST_CONTENT:
            kept.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(kept)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1 and words(r["text"]) >= 20]
    assert len(set(clean) & set(kept)) >= 0.97 * len(clean)
    assert sum(labels.get(i) == 0 for i in kept) <= 0.1 * sum(y == 0 for y in labels.values())


def test_stages_do_what_they_say(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    for name, stage in pipe.STAGES:
        before = [r.asDict() for r in docs.collect()]
        given, docs = docs, written(stage(spark, docs, SF), f"test-{name}")
        after = [r.asDict() for r in docs.collect()]
        if name == "packing":
            check_packing(before, after)
            break
        assert docs.columns == columns
        text = {r["doc_id"]: r["text"] for r in before}
        if name == "quality_rules":
            check_quality(spark, given, before, after)
        if name == "exact_dedup":
            best = defaultdict(int)
            for r in before:
                best[r["text"]] = max(best[r["text"]], r["doc_id"])
            assert {r["doc_id"] for r in after} == set(best.values()) and len(after) == len(best)
        if name == "near_dedup":
            want, _ = brute_components(sorted(text.items()))
            assert sorted(r["doc_id"] for r in after) == sorted(set(want.values()))
        if name == "mixing":
            check_mixing(before, after)


def test_stages_take_odd_rows(spark, odd, empty):
    """Nulls, empty and long texts, repeated rows and columns of any names go through every stage, and so does no row at all."""
    named = odd.filter("doc_id IS NULL OR doc_id <> 7").withColumns({c: F.lit("mine") for c in CLASHES if c.lower() not in ("size", "kept")})
    for docs in (named, empty, named.limit(0)):
        columns = docs.columns
        for name, stage in pipe.STAGES:
            before, docs = docs, written(stage(spark, docs, SF), f"test-odd-{name}")
            if name == "packing":
                check_packing(before.collect(), docs.collect())
            else:
                assert docs.columns == columns, name


def test_sequences_are_rebuilt_from_the_result(spark):
    """The packed ids alone give every copy's tokens, the cut copies' too."""
    prose = " ".join(f"word{i} of text" for i in range(3000))
    docs = spark.createDataFrame([(1, prose), (1, prose[:200]), (1, prose[:50]), (2, "short"), (3, None)], "doc_id long, text string")
    check_packing(docs.collect(), pipe.packing_stage(spark, docs, SF).collect())


def test_stages_broadcast_no_table_that_grows(spark, monkeypatch):
    """Even tables that Spark takes for small, as all are here, are merged; what a number of partitions or the capacity bounds may be broadcast."""
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    for module in (near_dedup, mixing, packing):
        monkeypatch.setattr(module, "written", noted)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 3 + j) % 97}" for j in range(40 + i % 3)), f"s{i % 2}") for i in range(90)], "doc_id long, text string, source string")
    for name, stage in pipe.STAGES[2:]:
        docs = noted(stage(spark, docs, SF), f"test-{name}")
        keys = {k for p in plans for k in re.findall(r"BroadcastHashJoin \[([^\]]*?)#", p)}
        assert any("SortMergeJoin" in p for p in plans), name
        assert keys <= {"near_dedup": set(), "mixing": {"part"}, "packing": {"in_3"}}[name], name
        plans.clear()
