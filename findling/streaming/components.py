"""Connected components that follow a stream of inserted and deleted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.plans.components import connected_components
from findling.storage import written

EDGE = "source_id string, target_id string, is_deleted boolean, batch int"
MEMBER = "node string, component string, batch int"


class IncrementalComponents:
    """Edges and components under ``folder``, a part for each batch; the last part that names an edge or a node holds.

    A batch reads the parts before its own and writes its own anew, so a batch that is run again changes nothing.
    Only components that a changed edge touches are recomputed, from their own edges.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in (("edges", EDGE), ("members", MEMBER)):
            spark.createDataFrame([], schema).drop("batch").write.mode("append").parquet(f"{self.folder}/{name}/batch=-1")

    def _parts(self, name: str, schema: str, before: int | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def edges(self, before: int | None = None) -> DataFrame:
        """Edges there are, after all batches or those before a number."""
        last = self._parts("edges", EDGE, before).groupBy("source_id", "target_id").agg(F.max_by("is_deleted", "batch").alias("is_deleted"))
        return last.filter("NOT is_deleted").select("source_id", "target_id")

    def members(self, before: int | None = None) -> DataFrame:
        """``node`` and ``component`` (the smallest node reachable) of every node with an edge."""
        last = self._parts("members", MEMBER, before).groupBy("node").agg(F.max_by("component", "batch").alias("component"))
        return last.filter("component <> ''")

    def stale(self, since: int) -> DataFrame:
        """Components that a batch from ``since`` on made, changed or ended."""
        now, then = self._parts("members", MEMBER, None).filter(F.col("batch") >= since), self.members(since)
        ended = now.select("node").distinct().join(then.hint("merge"), "node").select("component")
        return now.filter("component <> ''").select("component").unionByName(ended).distinct()

    def apply(self, changes: DataFrame, number: int) -> None:
        """Take batch ``number`` of changes (source_id, target_id, is_deleted, seq): of one edge's changes that with the largest seq.

        Edges are undirected. Loops and null ends are ignored; a deletion of an edge that isn't there changes nothing.
        """
        a, b = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
        good = changes.filter("source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id")
        new = good.groupBy(a.alias("source_id"), b.alias("target_id")).agg(F.max_by("is_deleted", "seq").alias("is_deleted"))
        self._write(new, "edges", number)
        new = self.spark.read.schema(EDGE).parquet(f"{self.folder}/edges/batch={number}").drop("batch")
        ends = new.select(F.col("source_id").alias("node")).unionByName(new.select(F.col("target_id").alias("node"))).distinct()
        before = self.members(number)
        # Sides that grow with the graph are merged: what is broadcast goes through the driver, which the many joins of a batch add up.
        touched = before.join(ends.hint("merge"), "node", "left_semi").select("component").distinct()
        nodes = written(before.join(touched.hint("merge"), "component", "left_semi").select("node").unionByName(ends).distinct(), "touched")
        # Both ends of an edge lie in one component, so an edge with a touched end is in.
        held = self.edges(number + 1).join(nodes.select(F.col("node").alias("source_id")).hint("merge"), "source_id", "left_semi")
        found = connected_components(held, "source_id", "target_id")
        self._write(nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("component", F.lit("")).alias("component")), "members", number)
