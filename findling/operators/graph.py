"""Property graphs as vertex and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findling.operators.vector import PUBLIC_LAYERS
from findling.plans.components import connected_components
from findling.session import dealt, ship

#: Type of a list of edges.
EDGES = "array<struct<source_id:string,target_id:string,type:string>>"


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def inner_edges(edges: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(id_col)
    return edges.join(ids, edges["source_id"] == ids[id_col], "left_semi").join(ids, edges["target_id"] == ids[id_col], "left_semi")


def local_search(entities: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, allowed: Sequence[str] | None = None, strict_path: bool = True, most_seeds: int | None = None) -> DataFrame:
    """Entities within ``hops`` undirected edges of the seeds (id), with ``distance``.

    Ends must lie in the allowed or public layers; with ``strict_path`` so must every node on
    the way. Each hop is one join of the frontier with the edges.
    """
    layers = list(dict.fromkeys([*(allowed or ()), *PUBLIC_LAYERS]))
    visible = entities.filter(F.col("layer_id").isin(*layers)).select("id")
    start = seeds.select("id").distinct().join(visible, "id", "left_semi")
    if most_seeds is not None:
        start = start.orderBy("id").limit(most_seeds)
    ways = both_ways(edges)
    if strict_path:
        ways = ways.join(visible, ways["b"] == visible["id"], "left_semi")
    seen = start.select("id", F.lit(0).alias("distance"))
    front = start
    for hop in range(1, hops + 1):
        reached = front.join(ways, F.col("id") == F.col("a"), "inner").select(F.col("b").alias("id")).distinct()
        front = reached.join(seen, "id", "left_anti")
        seen = seen.unionByName(front.select("id", F.lit(hop).alias("distance")))
    return seen.filter("distance > 0").join(visible, "id", "left_semi")


def components(edges: DataFrame, least: int = 2) -> DataFrame:
    """(id, component) of the connected components with at least ``least`` nodes."""
    found = connected_components(edges, "source_id", "target_id")
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return found.join(sizes, "component").select(F.col("node").alias("id"), "component")


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, parallel ones counted."""
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def hub_split(members: DataFrame, edges: DataFrame, least: int = 6) -> DataFrame:
    """``part`` hub or periphery: the upper half by degree in components of ``least`` nodes or more, else whole.

    The place of a node in its component is counted in two steps (nodes of each degree, then
    places within one), so a component of any size is ranked.
    """
    deg = members.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    per = deg.groupBy("component", "degree").agg(F.count("*").alias("n"))
    above = Window.partitionBy("component").orderBy(F.col("degree").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"before": F.coalesce(F.sum("n").over(above), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("component"))}).drop("n")
    inside = Window.partitionBy("component", "degree").orderBy("id")
    placed = deg.withColumn("__p", F.row_number().over(inside)).join(per, ["component", "degree"])
    hub = F.col("before") + F.col("__p") <= F.floor(F.col("total") / 2)
    return placed.select("id", "component", "degree", F.when(F.col("total") < least, "whole").when(hub, "hub").otherwise("periphery").alias("part"))


def upsert_relations(old: DataFrame, new: DataFrame, entities: DataFrame, many: int = 0) -> DataFrame:
    """New relations between existing entities replace those with the same id; ``many`` is about how many there are of both."""
    from findling.operators.tables import upsert

    # Merged: a broadcast of the entities counts in every task until it is too large for one.
    return upsert(old, inner_edges(new, entities.select("id").hint("merge")), ["id"], many)


def merge_entities(entities: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources of ``merges`` (source_id, target_id) go into their targets: edges move, descriptions and documents join, loops go."""
    m = merges.select(F.col("source_id").alias("__s"), F.col("target_id").alias("__t"))
    to = lambda e, c: e.join(m, e[c] == m["__s"], "left").withColumn(c, F.coalesce("__t", c)).drop("__s", "__t")
    moved = to(to(edges, "source_id"), "target_id").filter("source_id <> target_id")
    named = entities.join(m, entities["id"] == m["__s"], "left").withColumn("root", F.coalesce("__t", "id"))
    order = F.struct(F.col("__s").isNotNull(), F.col("id"))
    kept = named.groupBy("root").agg(
        F.min_by("name", order).alias("name"),
        F.min_by("type", order).alias("type"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__s").isNotNull(), F.col("id"), F.col("description")))), lambda x: x["description"]), "; ").alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_documents")))).alias("source_documents"),
    )
    return kept.withColumnRenamed("root", "id"), moved


def dedup_entities(entities: DataFrame, order_col: str, trim: bool = True) -> DataFrame:
    """One entity a name: first name and type, longest description (of equally long ones the first)."""
    key = F.lower(F.trim("name")) if trim else F.lower("name")
    agg = entities.withColumn("key", key).groupBy("key")
    return agg.agg(
        F.min_by("name", order_col).alias("name"),
        F.min_by("type", order_col).alias("type"),
        F.max_by("description", F.struct(F.length("description"), -F.col(order_col))).alias("description"),
    )


def resolve_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations by name become relations by id; unknown names drop them."""
    e = entities.select(F.lower("name").alias("k"), F.col("id").alias("i"))
    out = relations.join(e, F.lower("source_entity") == F.col("k")).withColumnRenamed("i", "source_id").drop("k")
    return out.join(e, F.lower("target_entity") == F.col("k")).withColumnRenamed("i", "target_id").drop("k")


def dominant_type(members: DataFrame, by: str, type_col: str = "type") -> DataFrame:
    """``dominant`` type of each group; ties by name."""
    n = members.groupBy(by, type_col).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.max_by(type_col, F.struct(F.col("n"), F.lit(0))).alias("any"), F.min(F.struct((-F.col("n")).alias("m"), F.col(type_col).alias("t"))).alias("b")).select(by, F.col("b.t").alias("dominant"))


def code_edges(chunks: DataFrame) -> DataFrame:
    """Edges of a code graph from chunks (id, file_path, node_type, parent_id, imports, bases, calls)."""
    inside = F.when(F.col("parent_id").isNotNull() & (F.col("node_type") == "function"), "HAS_METHOD").otherwise("CONTAINS")

    def named(col: str, kind: str, source: str) -> Column:
        edges = F.transform(col, lambda t: F.struct(F.col(source).alias("source_id"), t.alias("target_id"), F.lit(kind).alias("type")))
        return F.coalesce(edges.cast(EDGES), F.array().cast(EDGES))

    held = F.array(F.struct(F.coalesce("parent_id", "file_path").alias("source_id"), F.col("id").alias("target_id"), inside.alias("type")))
    # One list for a chunk, so that the chunks (which may come from a parser) are made once.
    lists = [held.cast(EDGES), named("imports", "IMPORTS", "file_path"), named("bases", "INHERITS", "id"), named("calls", "CALLS", "id")]
    return chunks.select(F.explode(F.concat(*lists)).alias("e")).select("e.*").distinct()


def python_chunks(files: DataFrame) -> DataFrame:
    """Classes and functions of Python files (file_path, text) with imports, bases and calls; other languages plug in the same way."""
    ship(files.sparkSession)
    schema = "file_path string, id string, node_type string, name string, parent_id string, start_line int, end_line int, signature string, imports array<string>, bases array<string>, calls array<string>, error string"

    def run(frames):
        import ast

        for frame in frames:
            out = []
            for path, text in zip(frame["file_path"], frame["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except SyntaxError as e:
                    out.append((path, path, "file", path, None, 0, 0, None, [], [], [], str(e)))
                    continue
                imports = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names] + [n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module]

                def visit(node, parent, path=path, imports=imports):
                    for n in ast.iter_child_nodes(node):
                        if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                            key = f"{parent or path}::{n.name}"
                            is_class = isinstance(n, ast.ClassDef)
                            bases = [ast.unparse(b) for b in n.bases] if is_class else []
                            calls = [] if is_class else sorted({ast.unparse(c.func) for c in ast.walk(n) if isinstance(c, ast.Call)})
                            signature = f"class {n.name}" if is_class else f"def {n.name}({ast.unparse(n.args)})"
                            out.append((path, key, "class" if is_class else "function", n.name, parent, n.lineno, n.end_lineno, signature, imports, bases, calls, None))  # noqa: B023
                            visit(n, key)

                visit(tree, None)
            yield pd.DataFrame(out, columns=["file_path", "id", "node_type", "name", "parent_id", "start_line", "end_line", "signature", "imports", "bases", "calls", "error"])

    return dealt(files.select("file_path", "text")).mapInPandas(run, schema)


def node_size(degree: Column) -> Column:
    return F.greatest(F.lit(10), F.least(F.lit(50), degree * 5))
