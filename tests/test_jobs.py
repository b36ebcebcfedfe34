"""Jobs, model steps and identifiers where a table of expected rows says more than SQL."""

import uuid

from pyspark.sql import functions as F

from findling.operators import governance, jobs, models
from findling.operators import tables as op
from findling.sources.store import ChunkStore


def test_uuid5(spark):
    names = ["ws:acme", "", "é:ü", "x" * 500]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(governance.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_add_documents_reports_what_arrived(spark, tmp_path):
    docs = spark.createDataFrame([(1, "file://a", "word " * 500, "w"), (2, "file://b", "  ", "w"), (3, "archive://c", "text", "w"), (4, "file://d", None, "w")], "doc_id long, path string, text string, workspace_id string")
    store = ChunkStore(spark, str(tmp_path / "s"), 8)
    got = {r["doc_id"]: (r["chunks"], r["status"]) for r in jobs.add_documents(store, docs, models.hash_embedder(8)).collect()}
    assert got == {1: (3, "embedded"), 2: (0, "failed"), 3: (0, "registered"), 4: (0, "failed")}
    assert store.read().count() == 3


def test_retries(spark):
    def load():
        def embed(text, n):
            if n < int(text):
                raise RuntimeError("later")
            return [float(n)]

        return embed

    rows = spark.createDataFrame([("1",), ("3",), ("4",)], "content string")
    assert {(r["content"], r["tries"], r["sync_status"]) for r in jobs.embed_with_retries(rows, load).collect()} == {("1", 1, "committed"), ("3", 3, "committed"), ("4", 3, "sync_error")}


def test_summaries_by_model_and_without(spark):
    members = spark.createDataFrame([("c", i, f"n{i}", "A" if i % 3 else "B", f"d{i}" if i % 2 else "") for i in range(60)] + [("e", 1, "x", "B", None)], "community string, id int, name string, type string, description string")
    plain = {r["community"]: (r["title"], r["summary"], r["size"]) for r in models.community_summaries(members).collect()}
    assert plain == {"c": ("A Community (60 entities)", "d1 d3 d5 d7 d9", 60), "e": ("B Community (1 entities)", "Community of 1 B entities", 1)}

    def load():
        def model(prompt):
            if "d1" not in prompt:
                raise ValueError("nothing known")
            return {"title": "T" * 80, "summary": str(prompt.count("\n"))}

        return model

    told = {r["community"]: (r["title"], r["summary"]) for r in models.community_summaries(members, load).collect()}
    assert told == {"c": ("T" * 50, "20"), "e": ("B Community (1 entities)", "Community of 1 B entities")}


def test_budgeted_history(spark):
    """Newest first while the total is under the budget; an overflow shortens one of the three newest and ends at an older pair."""
    say = lambda n: "a" * 4 * n
    chats = [("x", 1, say(5), say(5)), ("x", 2, say(5), say(5)), ("x", 3, say(10), say(10)), ("x", 4, say(200), say(2)), ("x", 5, say(10), say(10)), ("y", 1, None, say(1)), *[("z", i, say(1), say(1)) for i in range(50)]]
    df = spark.createDataFrame(chats, "conv string, turn int, u string, a string")
    got = {}
    for r in op.budgeted_history(df, 60, "conv", "turn", "u", "a").orderBy("conv", "place").collect():
        got.setdefault(r["conv"], []).append(r["turn"])
    # x: 20, then 202 overflows and even shortened takes 47, then 20 and 10; the last 10 would reach 60. z: 29 pairs of 2.
    assert got == {"x": [2, 3, 5], "y": [1], "z": list(range(21, 50))}


def test_rate_and_cache(spark):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = spark.createDataFrame([(i, "u", t(i * 3)) for i in range(8)] + [(8, "v", t(1))], "id int, who string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["id"] for r in jobs.admitted(rows, "who", "ts", "id", 5, 60).filter("is_admitted").collect()} == {0, 1, 2, 3, 4, 8}
    writes = rows.filter("id = 4").select("who", F.col("ts").alias("w"))
    live = jobs.live_entries(rows, writes, "who", "ts", "w", 15, F.to_timestamp(F.lit(t(21))))
    assert {r["id"] for r in live.collect()} == {5, 6, 7}
