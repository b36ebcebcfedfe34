"""Connected components: union-find in blocks of edges, then alternating stars."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.session import ship
from findling.storage import release, written

#: Edges that one task joins in memory.
BLOCK = 250_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a block as one star for each of its components, around the smallest node."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    n = table.num_rows
    codes, nodes = pd.factorize(np.array(table["u"].to_pylist() + table["v"].to_pylist(), dtype=object), sort=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(codes[:n].tolist(), codes[n:].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    pairs = [(i, r) for i in range(len(nodes)) if (r := find(i)) != i]
    if pairs:
        kind = table.schema.field("u").type
        yield pa.record_batch([pa.array([nodes[i] for i, _ in pairs], kind), pa.array([nodes[r] for _, r in pairs], kind)], names=["u", "v"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of an edge.

    Edges are undirected; loops, repeats and nulls are ignored. More than a block of edges are
    reduced to those that join something after up to four edges of each node have. Blocks of edges are
    joined by union-find, each in a task of bounded size. Where there is more than one
    block, rounds follow that point every neighbour of a node at the smallest node near
    it, first the larger neighbours, then the smaller ones, until nothing changes: a
    number of rounds that grows with the logarithm of the size, whatever the diameter. A
    hub's messages are joined, not grouped, so its partition can be split. Joins merge: tables of nodes aren't broadcast,
    for rounds would add up what that sends through the driver.
    """
    ship(edges.sparkSession)
    a, b = F.col(src), F.col(dst)
    given = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    given = written(given, "components")
    n = given.count()
    now = _joined(given, n) if n <= BLOCK else _sampled(given)
    release(given)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _joined(given: DataFrame, n: int) -> DataFrame:
    """Stars (u, v) around the smallest node of each component of ``n`` edges (u > v)."""
    kind = given.schema["u"].dataType.simpleString()
    blocks = max(1, math.ceil(n / BLOCK))
    now = written(given.repartition(blocks).mapInArrow(_forest, f"u {kind}, v {kind}"), "components")
    return _stars(now) if blocks > 1 else now


def _sampled(given: DataFrame) -> DataFrame:
    """As :func:`_joined`, first over the smallest and the largest of each node's lower and of its higher neighbours, then over those of all other edges that still join something.

    Where nodes have many edges, few are left to join after the first step, so rounds don't shuffle them all.
    """
    ends = given.groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y")).unionByName(given.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("x"), F.max("u").alias("y")))
    pairs = ends.select("u", F.explode(F.array("x", "y")).alias("v"))
    few = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    stars = _joined(few, few.count())
    release(few)
    named = stars.select(F.col("u").alias("node"), F.col("v").alias("root")).hint("merge")
    root = lambda e, end: e.join(named, e[end] == named["node"], "left").withColumn(end, F.coalesce("root", end)).select("u", "v")
    left = root(root(given, "u"), "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    left = written(left, "components")
    n = left.count()
    if n == 0:
        release(left)
        return stars
    upper = _joined(left, n).select(F.col("u").alias("was"), F.col("v").alias("top"))
    release(left)
    # Every root that moves on points at the top itself.
    moved = stars.join(upper.hint("merge"), stars["v"] == upper["was"], "left").select("u", F.coalesce("top", "v").alias("v"))
    return written(moved.unionByName(upper.select(F.col("was").alias("u"), F.col("top").alias("v"))), "components")


def _stars(now: DataFrame) -> DataFrame:
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        new = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "components")
        release(now)
        now, before, state = new, state, _state(new)
        if state == before:
            return now


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
