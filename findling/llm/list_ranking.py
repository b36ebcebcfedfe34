"""Ranking of linked lists: prefix sums along ``next`` pointers, in tasks of bounded size.

1. Elements are dealt by ranges of their identifiers; in each block, chains that stay inside
   it shrink to their first element. Lists whose neighbours mostly have near identifiers are nearly done then.
2. While more elements are left than one block holds, every element whose random priority is
   below that of both neighbours is taken over by the one before it: a third of them in each
   round, whatever the list looks like, so all rounds together move about three times the list.
3. What is left fits one block. Then the steps are undone in reverse: whoever was taken over
   adds its distance to the sum of its taker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.session import ship
from findling.storage import release, written

#: Elements that one task holds in memory.
BLOCK = 100_000


def contracted(ids: np.ndarray, after: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chains among ``ids`` (sorted): head and sums before it for each element, and at heads the chain's next and its sums.

    ``after`` is -1 at a list's end; ``weights`` has a row for each weight.
    """
    n = len(ids)
    at = np.minimum(np.searchsorted(ids, after), n - 1)
    inside = ids[at] == after
    head, off = np.arange(n), np.zeros_like(weights)
    head[at[inside]] = np.flatnonzero(inside)
    off[:, at[inside]] = weights[:, inside]
    while True:
        further = head[head]
        if np.array_equal(further, head):
            break
        off, head = off + off[:, head], further
    onward, total = np.full(n, -1), np.zeros_like(weights)
    last = np.flatnonzero(~inside)
    onward[head[last]] = after[last]
    total[:, head[last]] = off[:, last] + weights[:, last]
    return head, off, onward, total


def _contract(weights: list[str]) -> Callable[[pa.Table], pa.Table]:
    def work(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.argsort(ids)
        ids, after = ids[order], table["next"].fill_null(-1).to_numpy()[order]
        w = np.array([table[c].to_numpy()[order] for c in weights]).reshape(len(weights), -1)
        head, off, onward, total = contracted(ids, after, w)
        first = head == np.arange(len(ids))
        out = {"id": ids, "head": ids[head], "next": pa.array(onward, pa.int64(), mask=onward < 0)}
        return pa.table(out | {c: np.where(first, total[k], off[k]) for k, c in enumerate(weights)})

    return work


def _blocks(rows: DataFrame, weights: list[str], block: Column) -> DataFrame:
    """Every element with its head; ``weights`` are the whole chain's at a head, else what lies between."""
    schema = "id long, head long, next long, " + ", ".join(f"{c} long" for c in weights)
    return written(rows.select("id", "next", *weights, block.alias("block")).groupBy("block").applyInArrow(_contract(weights), schema), "rank-blocks")


def _priority(of: str, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), F.col(of))


def list_rank(elements: DataFrame, weights: list[str], block: int = BLOCK) -> DataFrame:
    """``id`` and, under the names of ``weights``, each weight's sum over all elements before it in its list.

    ``elements`` has ``id`` (unique, not negative), ``next`` (an ``id``, null at the end of a list) and long weights.
    There may be several lists, but no cycles. An empty table gives an empty result.
    """
    ship(elements.sparkSession)
    found = _blocks(elements, weights, F.floor(F.col("id") / F.lit(block)))
    # Who was taken over, by whom, with the sums from the taker to it; undone in reverse.
    undo = [found.filter("id != head").select("id", "head", *weights)]
    left, turn = found.filter("id = head").select("id", "next", *weights), 0
    while left.count() > block:
        turn += 1
        sums = [(F.col(f"u.{c}") + F.col(f"v.{c}")).alias(c) for c in weights]
        taker = left.filter(_priority("id", turn) > _priority("next", turn))
        low = left.filter(F.col("next").isNull() | (_priority("id", turn) < _priority("next", turn)))
        pairs = taker.alias("u").join(low.alias("v"), F.col("u.next") == F.col("v.id"))
        pairs = pairs.select(F.col("u.id").alias("id"), F.col("v.id").alias("gone"), F.col("v.next").alias("next"), *sums, *[F.col(f"u.{c}").alias(f"off_{c}") for c in weights])
        pairs = written(pairs, "rank-pairs")
        undo.append(pairs.select(F.col("gone").alias("id"), F.col("id").alias("head"), *[F.col(f"off_{c}").alias(c) for c in weights]))
        touched = pairs.select("id").unionByName(pairs.select(F.col("gone").alias("id")))
        left = left.join(touched, "id", "left_anti").unionByName(pairs.select("id", "next", *weights))
        left = written(left, "rank-left")
    last = _blocks(left, weights, F.lit(0))
    known = last.select("id", *[F.when(F.col("id") == F.col("head"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in weights])
    for gone in reversed(undo):
        back = gone.alias("g").join(known.alias("k"), F.col("g.head") == F.col("k.id"))
        back = back.select(F.col("g.id").alias("id"), *[(F.col(f"g.{c}") + F.col(f"k.{c}")).alias(c) for c in weights])
        known, before = written(known.unionByName(back), "rank-known"), known
        release(before)
    return known
