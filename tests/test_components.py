"""Components of more edges than a block, where few edges of each node come first."""

import random

import pytest

from findling.plans import components as op


@pytest.mark.parametrize("shape", ["dense", "chains"])
def test_most_edges_join_nothing_in_rounds(spark, monkeypatch, shape):
    monkeypatch.setattr(op, "BLOCK", 60)
    rng = random.Random(3)
    if shape == "dense":
        rows = [(f"g{g}_{rng.randrange(30)}", f"g{g}_{rng.randrange(30)}") for g in range(3) for _ in range(300)]
    else:  # groups of three that hang together by edges which are no node's first or last on either side
        rows = [(f"{a}{i:02}", f"{b}{i:02}") for i in range(30) for a, b in ("kl", "kz", "pa", "po", "kp")]
    taken, joined = [], op._joined
    monkeypatch.setattr(op, "_joined", lambda e, n: taken.append(n) or joined(e, n))
    found = {r["node"]: r["component"] for r in op.connected_components(spark.createDataFrame(rows, "src string, dst string")).collect()}
    near = {}
    for a, b in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert found[start] == min(seen)
    assert found.keys() == near.keys()
    assert shape == "chains" and len(taken) == 2 or sum(taken) < len(rows)


def test_nothing_that_grows_with_the_graph_is_broadcast(spark, monkeypatch, tmp_path):
    """Batches of an incremental graph over several blocks: no plan that is written holds a broadcast."""
    from pyspark.sql import DataFrameWriter
    from pyspark.sql import functions as F

    from findling.streaming.components import IncrementalComponents

    monkeypatch.setattr(op, "BLOCK", 60)
    plans, write = [], DataFrameWriter.parquet

    def noted(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    edges = spark.range(400).select(F.concat(F.lit("d"), "id").alias("source_id"), F.concat(F.lit("e"), (F.col("id") * 7 % 90)).alias("target_id"), F.lit(False).alias("is_deleted"), F.lit(0).alias("seq"), (F.col("id") % 2).alias("half"))
    graph = IncrementalComponents(spark, str(tmp_path))
    for number in range(2):
        graph.apply(edges.filter(F.col("half") == number).drop("half"), number)
    assert graph.members().count() == 490 and graph.members().select("component").distinct().count() == 90
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)
