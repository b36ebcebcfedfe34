"""Memories of users: facts that add, replace or remove what is remembered, by similarity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.functions import vectors as V
from findling.operators.vector import top_k
from findling.session import ship
from findling.storage import written

#: Memories and facts of one block of comparisons.
BLOCK = 1000


def nearest_memories(held: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """(fact_id, memory_id, similarity) of each fact's nearest memory of its user with cosine >= ``least``.

    Ties go to the smallest memory. A user's memories and facts are dealt to blocks of about BLOCK by hash, and each
    pair of blocks is one matrix product that returns the best of its block for each fact: users of any size are split,
    and no pairs are emitted. Rows without user, identifier or direction have no neighbours.
    """
    spark = held.sparkSession
    ship(spark)

    def given(rows: DataFrame, id_col: str) -> DataFrame:
        rows = rows.select("user_id", F.col(id_col).alias("id"), F.col("embedding").alias("raw")).filter("user_id IS NOT NULL AND id IS NOT NULL AND raw IS NOT NULL")
        return rows.filter(V.norm(F.col("raw")) > 0).select("user_id", "id", V.normalise(F.col("raw")).alias("v"))

    old, new = given(held, "memory_id"), given(facts, "fact_id")
    count = lambda rows, name: rows.groupBy("user_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = count(old, "held_blocks").join(count(new, "fact_blocks"), "user_id")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(blocks, "user_id").withColumn(own, F.pmod(F.xxhash64("id"), f"{own}s").cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).select(*[F.col(c).alias(c) for c in ("user_id", "held_block", "fact_block", "id", "v")])

    keys = ["user_id", "held_block", "fact_block"]
    out = T.StructType([T.StructField("fact_id", facts.schema["fact_id"].dataType), T.StructField("memory_id", held.schema["memory_id"].dataType), T.StructField("similarity", T.DoubleType())])

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        # Sorted by identifier, so that argmax takes the smallest of equals.
        x = x.sort_by("id")
        memories, asked = x["id"].combine_chunks(), y["id"].combine_chunks()
        if not len(memories) or not len(asked):
            return pa.table([asked.slice(0, 0), memories.slice(0, 0), pa.array([], pa.float64())], names=out.names)
        near = np.round(np.array(y["v"].to_pylist()) @ np.array(x["v"].to_pylist()).T, 9)
        at = near.argmax(axis=1)
        high = near[np.arange(len(at)), at]
        close = np.flatnonzero(high >= least)
        return pa.table([asked.take(pa.array(close)), memories.take(pa.array(at[close])), pa.array(high[close])], names=out.names)

    left, right = dealt(old, "held_block", "fact_block"), dealt(new, "fact_block", "held_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, out)
    one = found.groupBy("fact_id").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "memory_id")).alias("b"))
    return one.select("fact_id", F.col("b.memory_id").alias("memory_id"), (-F.col("b.far")).alias("similarity"))


def decide(held: DataFrame, facts: DataFrame, least: float = 0.9) -> DataFrame:
    """What each fact does: (user_id, fact_id, memory_id, similarity, action).

    ``held`` are (user_id, memory_id, content, embedding), ``facts`` (user_id, fact_id, content, embedding, forget), with
    identifiers that no memory has. With a memory of the user at ``least`` or nearer a fact is ``DELETE`` if it asks to
    forget, ``NONE`` if it says the same, else ``UPDATE``; without one it is ``NONE`` if it asks to forget, else ``ADD``. Of
    the facts that change one memory the one with the largest identifier counts, of equal new ones the smallest;
    the others are ``NONE``. Facts of one call don't see each other otherwise. Those without user or identifier do nothing.
    """
    near = nearest_memories(held, facts, least)
    said = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256)
    known = held.select("memory_id", said("content").alias("known"))
    told = facts.filter("user_id IS NOT NULL AND fact_id IS NOT NULL").select("user_id", "fact_id", said("content").alias("told"), F.coalesce("forget", F.lit(False)).alias("forget"))
    rows = told.join(near, "fact_id", "left").join(known, "memory_id", "left")
    found = F.col("memory_id").isNotNull()
    action = F.when(found & F.col("forget"), "DELETE").when(F.col("forget") | (found & (F.col("known") == F.col("told"))), "NONE").when(found, "UPDATE").otherwise("ADD")
    rows = written(rows.withColumn("action", action).drop("known", "forget"), "memory-actions")
    last = rows.filter(F.col("action").isin("DELETE", "UPDATE")).groupBy("memory_id").agg(F.max("fact_id").alias("last"))
    first = rows.filter("action = 'ADD'").groupBy("user_id", "told").agg(F.min("fact_id").alias("first"))
    rows = rows.join(last, "memory_id", "left").join(first, ["user_id", "told"], "left")
    beaten = (F.col("action").isin("DELETE", "UPDATE") & (F.col("fact_id") != F.col("last"))) | ((F.col("action") == "ADD") & (F.col("fact_id") != F.col("first")))
    return rows.select("user_id", "fact_id", "memory_id", "similarity", F.when(beaten, "NONE").otherwise(F.col("action")).alias("action"))


def remember(held: DataFrame, facts: DataFrame, least: float = 0.9) -> DataFrame:
    """``held`` after the facts: changed memories keep their identifier, added ones have that of the fact."""
    acts = written(decide(held, facts, least).filter("action <> 'NONE'"), "memory-changes")
    new = facts.select("fact_id", F.col("content").alias("__content"), F.col("embedding").alias("__embedding"))
    changed = acts.filter("action <> 'ADD'").join(new, "fact_id").select("memory_id", "action", "__content", "__embedding")
    kept = held.join(changed, "memory_id", "left").filter("action IS NULL OR action = 'UPDATE'")
    use = lambda c: F.when(F.col("action").isNull(), F.col(c)).otherwise(F.col(f"__{c}")).alias(c)
    kept = kept.select("user_id", "memory_id", use("content"), use("embedding"))
    added = acts.filter("action = 'ADD'").join(new, "fact_id").select("user_id", F.col("fact_id").alias("memory_id"), F.col("__content").alias("content"), F.col("__embedding").alias("embedding"))
    return kept.unionByName(added)


def recall(held: DataFrame, user_id: object, query: Sequence[float], k: int = 5) -> DataFrame:
    """The user's nearest memories, and nobody else's."""
    own = held.filter(F.col("user_id") == F.lit(user_id)).withColumn("layer_id", F.lit("default"))
    return top_k(own, query, k, id_col="memory_id").drop("layer_id")


def forget_user(held: DataFrame, user_id: object) -> DataFrame:
    """All memories but the user's."""
    return held.filter(~F.col("user_id").eqNullSafe(F.lit(user_id)))
