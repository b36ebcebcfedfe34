from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from findling.operators import access, communities, graph, tables
from findling.operators import governance as gov
from findling.plans import components as comp
from findling.plans import graph_queries
from findling.plans.components import connected_components

SF = "/root/testdata/sf0.001"


def test_token_layers(spark):
    rows = [("alice", ["group:hr"]), ("bob", ["group:engineering"]), ("charlie", ["admin"]), ("dave", [])]
    got = {r["u"]: set(r["l"]) for r in spark.createDataFrame(rows, "u string, r array<string>").select("u", access.token_layers(F.col("u"), F.col("r")).alias("l")).collect()}
    base = {"default", "public"}
    assert got == {"alice": base | {"alice", "layer_hr"}, "bob": base | {"bob", "layer_engineering"}, "charlie": base | {"charlie", "restricted", "admin"}, "dave": base | {"dave"}}


def test_quota(spark):
    rows = spark.createDataFrame([(100, 150), (100, 50), (100, 100)], "storage_quota_bytes long, storage_used_bytes long")
    assert [r["exceeded"] for r in access.quota(rows).collect()] == [True, False, True]
    assert [r["used_after"] for r in access.quota(rows, F.lit(-200)).collect()] == [0, 0, 0]


def test_patterns_meet_roles_that_begin_alike(spark):
    layers = spark.createDataFrame([(i, i, "TEAM", False) for i in "abcdef"], "id string, name string, type string, is_soft_deleted boolean")
    patterns = {"a": "eng*", "b": "*", "c": "e_g", "d": "eng", "e": "%r", "f": "engineering-team*"}
    grants = spark.createDataFrame([(k, v, "READ") for k, v in patterns.items()] * 2, "layer_id string, role_pattern string, access_level string")
    roles = spark.createDataFrame([(1, "eng"), (2, "engineer"), (3, ""), (4, None), (5, "hr")], "user_id int, role string")
    got = {(r["user_id"], r["layer_id"]) for r in access.resolve_layers(roles, layers, grants).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a"), (2, "b"), (2, "e"), (3, "b"), (5, "b"), (5, "e")}



@pytest.mark.parametrize("block", [3, 250_000])
def test_components_of_any_shape(spark, monkeypatch, block):
    monkeypatch.setattr(comp, "BLOCK", block)
    path = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(30)]
    star = [("hub", f"s{i}") for i in range(20)]
    edges = spark.createDataFrame([*path, *star, ("x", "x"), (None, "y"), ("a", "b"), ("b", "a")], "src string, dst string")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {got[f"p{i:02d}"] for i in range(31)} == {"p00"} and {got[f"s{i}"] for i in range(20)} == {"hub"}
    assert got["a"] == got["b"] == "a" and "x" not in got and "y" not in got


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def sold(spark):
    """Customer and part of every line of an order."""
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        lines[r["l_orderkey"]].append(f"p{r['l_partkey']}")
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    return [(f"c{r['o_custkey']}", p) for r in orders for p in lines[r["o_orderkey"]]]


def test_component_query_takes_every_order(spark):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in sold(spark):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {r["id"]: r["component"] for r in graph_queries.g6(spark, SF).collect()} == {x: find(x) for x in list(root)}


def test_community_query_has_all_levels_and_nodes(spark):
    nodes = {x for pair in sold(spark) for x in pair}
    got = defaultdict(set)
    for r in graph_queries.g7(spark, SF).collect():
        got[r["level"]].add(r["id"])
    assert got == {level: nodes for level in range(3)}


def test_speakers(spark):
    seg = spark.createDataFrame([("m", 1, 0.0, 100.0), ("m", 2, 100.0, 200.0), ("m", 3, 900.0, 901.0)], "m string, seg_id int, start double, end double")
    turn = spark.createDataFrame([("m", 0.0, 50.0, "A"), ("m", 50.0, 100.0, "B"), ("m", 90.0, 180.0, "C")], "m string, start double, end double, speaker string")
    assert [r["speaker"] for r in tables.interval_speakers(seg, turn, "m").orderBy("seg_id").collect()] == ["A", "C", "Unknown"]


def test_history_shortens_the_newest(spark):
    rows = [("x", 1, "u" * 40, "a" * 40), ("y", 1, "u" * 4000, "a" * 40), ("z", 1, "abcdefgh" * 10, None)]
    got = {r["c"]: r for r in tables.budgeted_history(spark.createDataFrame(rows, "c string, t int, u string, a string"), 100, "c", "t", "u", "a").collect()}
    assert got["x"]["user"] == "u" * 40 and got["z"]["assistant"] == ""
    assert tables.TRUNCATED in got["y"]["user"] and len(got["y"]["user"]) // 4 <= 100 and got["y"]["assistant"] == "a" * 40


def test_middle_goes_in_whole_tokens(spark):
    cut = spark.createDataFrame([("".join(chr(97 + i) * 4 for i in range(9)) + "z",)], "x string").select(tables.without_middle(F.col("x"), 4, "|")).first()[0]
    # 9 whole tokens and one of a character; the middle is 5, and (9 - 4 + 1) / 2 = 3 go on either side of it.
    assert cut == "aaaabbbb|iiiiz"


def test_running_sums_of_a_hot_group(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 > 0, NULL, CAST(id % 7 AS STRING)) AS g", "id", "id % 11 AS v").repartition(5)
    got = tables.running_sums(rows, ["g"], ["id"], {"before": F.col("v"), "nth": F.lit(1)}).collect()
    sums = {}
    for r in sorted(got, key=lambda r: r["id"]):
        assert (r["before"], r["nth"]) == sums.get(r["g"], (0, 0))
        sums[r["g"]] = (r["before"] + r["v"], r["nth"] + 1)
    assert len(got) == 5000


def test_merge_moves_edges(spark):
    e = spark.createDataFrame([("a", "A", "t", "d1", ["x"]), ("b", "B", "t", "d2", ["y"])], "id string, name string, type string, description string, source_documents array<string>")
    r = spark.createDataFrame([("1", "b", "a"), ("2", "b", "c")], "id string, source_id string, target_id string")
    kept, moved = graph.merge_entities(e, r, spark.createDataFrame([("b", "a")], "source_id string, target_id string"))
    assert kept.first()["description"] == "d1; d2" and kept.first()["name"] == "A" and kept.count() == 1
    assert [tuple(x) for x in moved.select("id", "source_id", "target_id").collect()] == [("2", "a", "c")]


def test_communities_find_two_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(6) for j in range(i)]
    edges = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0", 1.0)], "source_id string, target_id string, weight double")
    found = communities.communities(edges, levels=1).withColumnRenamed("level", "l")
    assert communities.modularity(edges, found) > 0.3


def test_python_chunks(spark):
    src = "import os\nclass A(B):\n    def f(self):\n        return g(1)\n"
    rows = {r["id"]: r for r in graph.python_chunks(spark.createDataFrame([("f.py", src), ("bad.py", "def")], "file_path string, text string")).collect()}
    assert rows["f.py::A"]["bases"] == ["B"] and rows["f.py::A::f"]["parent_id"] == "f.py::A" and rows["f.py::A::f"]["calls"] == ["g"]
    assert rows["bad.py"]["error"]


def test_sync_and_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, t string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, t string")
    assert {r["k"]: r["action"] for r in gov.sync_difference(old, new, "k", "t").collect()} == {1: "remove", 2: "replace", 3: "keep", 4: "add"}


def test_tasks_of_relations_stay_as_small(spark, monkeypatch):
    """Twice the rows are twice the partitions that join, aggregate and upsert; the result is the same."""
    from findling import session
    from findling.plans import graph_queries, tables as derived

    sf = "/root/testdata/sf0.001"
    key = lambda r: tuple(r)
    want = sorted(map(key, graph_queries.g2(spark, sf).collect()))
    for rows in (400, 200):
        monkeypatch.setattr(session, "SPREAD", rows)
        made = graph_queries.g2(spark, sf)
        assert made.rdd.getNumPartitions() >= len(want) / rows
        assert derived.edges(spark, sf).rdd.getNumPartitions() >= 5000 / rows
        assert sorted(map(key, made.collect())) == want
