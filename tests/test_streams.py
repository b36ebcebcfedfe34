"""Streams with state, fragments cut anywhere, and components that follow changes of edges."""

import random
import tempfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findling.streaming.components import IncrementalComponents
from findling.streaming.documents import DocumentChain, parsed, status_with_history
from findling.streaming.state import run_batches


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_follow_changes(spark):
    """After each batch, and after a batch run twice, the same as over all edges there are."""
    rng, held = random.Random(4), {}
    index = IncrementalComponents(spark, tempfile.mkdtemp(prefix="findling-"))
    for number in range(3):
        rows = []
        for seq in range(25):
            a, b = (f"n{rng.randrange(30):02d}" for _ in range(2))
            gone = number > 0 and rng.random() < 0.5
            if gone and held:
                a, b = rng.choice(list(held))[:: rng.choice((1, -1))]
            rows.append((a, b, gone, seq))
            if a != b:
                held.pop((min(a, b), max(a, b)), None)
                if not gone:
                    held[min(a, b), max(a, b)] = True
        before = {r["node"]: r["component"] for r in index.members().collect()}
        df = spark.createDataFrame([*rows, (None, "n01", False, 0)], "source_id string, target_id string, is_deleted boolean, seq int")
        for _ in range(1 + (number == 1)):
            index.apply(df, number)
        now = {r["node"]: r["component"] for r in index.members().collect()}
        assert now == plain_components(held)
        changed = {c for n in {*before, *now} if before.get(n) != now.get(n) for c in (before.get(n), now.get(n)) if c}
        assert changed <= {r["component"] for r in index.stale(number).collect()}


@given(st.lists(st.sampled_from(["<think>", "</think>", "<thi", "nk>", "</", "a", "b c", "<"]), max_size=12), st.lists(st.integers(0, 60), max_size=8))
@settings(max_examples=300, deadline=None)
def test_any_cutting_gives_the_same(parts, cuts):
    text = "".join(parts)
    at = sorted({0, len(text), *[c for c in cuts if c < len(text)]})
    results = []
    for ends in (at, [0, len(text)]):
        inside, held, seen, thought = False, "", "", ""
        for a, b in zip(ends, ends[1:]):
            v, t, inside, held = parsed(text[a:b], inside, held)
            seen, thought = seen + v, thought + t
        results.append((seen, thought, inside, held))
    assert results[0] == results[1]
    assert results[0][0] + results[0][1] + results[0][3] == "".join(results[0][:2]) + results[0][3]


def test_status_goes_on_after_a_restart(spark):
    root = tempfile.mkdtemp(prefix="findling-")
    schema = "document_id string, status string, ts timestamp"
    add = lambda rows: spark.createDataFrame(rows, "document_id string, status string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    add([("a", "queued", "2024-01-01 00:00:01"), ("a", "failed", "2024-01-01 00:00:02"), ("b", "processing", "2024-01-01 00:00:01"), ("b", "queued", "2024-01-01 00:00:05")])
    run = lambda: {r["document_id"]: tuple(r)[1:] for r in status_with_history(spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/out").collect()}
    first = {"a": ("failed", 2, "queued>failed"), "b": ("processing", 2, "processing")}
    assert run() == first and run() == first
    add([("a", "queued", "2024-01-01 00:00:09"), ("a", "completed", "2024-01-01 00:00:10")])
    assert run() == first | {"a": ("completed", 4, "queued>failed>queued>completed")}


def flaky():
    def embed(text, n):
        if "never" in text or "late" in text and n == 1:
            raise RuntimeError("not now")
        return [float(len(text))]

    return embed


def test_chain_queues_failed_documents_again(spark):
    root = tempfile.mkdtemp(prefix="findling-")
    chain = DocumentChain(spark, root, flaky(), lambda text: [w for w in text.split() if w[:1].isupper()])
    for i, rows in enumerate([[(1, "Ada met Bob a@b.org"), (2, "late Bob"), (3, "never Eve")], [(4, "Cid alone")], [(5, "Ada again")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{root}/in/{i}")
        stream = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").parquet(f"{root}/in")
        run_batches(stream, chain.apply, f"{root}/checkpoint")
    got = {r["doc_id"]: (r["status"], r["tries"]) for r in chain.documents().collect()}
    assert got == {1: ("completed", 1), 2: ("completed", 2), 3: ("failed", 3), 4: ("completed", 1), 5: ("completed", 1)}
    members = {r["node"]: r["component"] for r in chain.graph.members().collect()}
    assert members["d1"] == members["d2"] == members["d5"] == "d1" and members["d4"] == "d4" and "d3" not in members
