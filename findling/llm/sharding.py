"""A uniform shuffle into shards of exact size.

Each input partition is permuted locally; the numbers of rows that go from each
partition to each shard are drawn from the multivariate hypergeometric
distribution, which is what a uniform permutation of all rows would give; the rows are
exchanged by that matrix and permuted again inside their shard. Every row moves once.

The driver draws the matrix some partitions at a time and writes it, so it holds a bounded part of it
whatever the number of rows or partitions. The second permutation orders a shard by a hash. Ranges of that hash are the
tasks that sort, of about CELL_BYTES each; counts of the ranges give each its first slot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.llm.common import Columns
from findling.storage import appended, written

ROW_MASK = (1 << 33) - 1
#: Bytes of rows that one task orders, about; a longer row is a task's own.
CELL_BYTES = 4 << 20
#: Counts of the matrix that the driver holds at once.
DRAWN = 4_000_000
#: Totals up to which the library draws.
MOST_DRAWN = 900_000_000


def even_sizes(total: int, parts: int) -> list[int]:
    """``parts`` counts that sum to ``total`` and differ by one at most."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def draw_rows(rows: Iterator[int], shards: list[int], seed: int) -> Iterator[np.ndarray]:
    """The matrix line by line: how many of a partition's rows go to each shard. Lines and columns sum to the arguments."""
    rng = np.random.default_rng(seed)
    left = np.array(shards, dtype=np.int64)
    for n in rows:
        if n > left.sum():
            raise ValueError("the shards must hold exactly the rows")
        line = _draw(rng, left, n)
        left -= line
        yield line
    if left.sum():
        raise ValueError("the shards must hold exactly the rows")


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    if left.sum() < MOST_DRAWN:
        return rng.multivariate_hypergeometric(left, n)
    out, rest = np.zeros_like(left), int(left.sum())
    for j, good in enumerate(left.tolist()):
        out[j] = k = _hypergeometric(rng, good, rest - good, n)
        n, rest = n - k, rest - good
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """For totals beyond what the library draws: by the sums of the chances around the mode, as far as they count."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(max(1.0, n * (good / total) * (bad / total)))
    first, last = max(low, mode - int(12 * spread) - 60), min(high, mode + int(12 * spread) + 60)
    k = np.arange(first, last, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    chance = np.concatenate([[0.0], np.cumsum(step)])
    chance = np.cumsum(np.exp(chance - chance.max()))
    return first + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def _bytes(table: DataFrame) -> Column:
    """About what a row's columns take."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in table.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    out = F.lit(8 * len(table.columns)).cast("long")
    for s in strings:
        out = out + s
    return out


def shuffle_into_shards(docs: DataFrame, n_shards: int, seed: int = 0, cell_bytes: int = CELL_BYTES, order_cols: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    Sizes of shards differ by one row at most. ``order_cols`` (those there are) seed the local
    permutations by content; rows that are equal in them may change places. Nulls in
    any column, empty and very long texts and repeated rows are rows like any other: the
    exchange goes by place and a hash of it, not by key, so no key can be hot. An empty table gives
    an empty result. Columns may have any names; those called ``shard`` or ``slot``, in any case, are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    own = Columns(docs, ("shard", "slot"))
    lower = [n.lower() for n in own.names]
    order = [own.at(c) for c in order_cols if c.lower() in lower]
    local = own.table.withColumn("k", F.xxhash64(F.lit(seed), *[F.col(c) for c in order])).sortWithinPartitions("k", *order)
    placed = local.select(*own.kept, "k", F.monotonically_increasing_id().alias("place"))
    placed = written(placed.withColumn("bytes", _bytes(placed)), "shard-input")
    placed = placed.withColumns({"from": F.shiftright("place", 33), "rank": F.col("place").bitwiseAND(F.lit(ROW_MASK))})

    # Partitions one after the other; what the driver holds of the counts and of the matrix is bounded.
    counts = written(placed.groupBy("from").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy("from"), "shard-counts")
    total, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = even_sizes(total, n_shards)
    lines = draw_rows((r["n"] for r in counts.orderBy("from").toLocalIterator()), shards, seed)
    names = (r["from"] for r in counts.orderBy("from").toLocalIterator())
    matrix = appended(spark, _chunks(names, lines, max(1, DRAWN // n_shards)), "from long, ends array<long>", "shard-matrix")

    # Spark knows the size of the written matrix: it broadcasts below its bound and shuffles beyond.
    at = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    routed = placed.join(matrix, "from").withColumn("shard", at.cast("int")).withColumn("again", F.xxhash64(F.lit(seed + 1), "k", "place"))
    bits = max(0, math.ceil(math.log2(max(1, size / n_shards / cell_bytes))))
    routed = routed.withColumn("cell", (F.shiftrightunsigned("again", 64 - bits) if bits else F.lit(0)).cast("long"))
    cells = written(routed.groupBy("shard", "cell").agg(F.count("*").alias("n")), "shard-cells")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("again", "place")
    ranked = routed.select(*own.kept, "shard", "cell", "again", "place").withColumn("nth", F.row_number().over(inside))
    ranked = ranked.join(cells, ["shard", "cell"])
    return ranked.select(*own.own(), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))


def _chunks(names: Iterator[int], lines: Iterator[np.ndarray], n: int) -> Iterator[list[tuple]]:
    chunk = []
    for name, line in zip(names, lines, strict=True):
        chunk.append((name, np.cumsum(line).tolist()))
        if len(chunk) == n:
            yield chunk
            chunk = []
    if chunk:
        yield chunk
