"""Listings, counts, budgets and histories over relational tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findling.session import spread
from findling.storage import written


def page(rows: DataFrame, order: Sequence, offset: int, limit: int) -> DataFrame:
    """One page in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_with_more(rows: DataFrame, order: Sequence, number: int, size: int) -> DataFrame:
    """A page with ``has_more``, found by asking for one row beyond it."""
    got = page(rows, order, (number - 1) * size, size + 1).withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    return got.withColumn("has_more", F.max("__n").over(Window.partitionBy()) > size).filter(F.col("__n") <= size).drop("__n")


def dynamic_filter(rows: DataFrame, **equal) -> DataFrame:
    """Equality for each argument that isn't None."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def point_get(local: DataFrame, shared: DataFrame, key_col: str, key) -> DataFrame:
    """The row of the workspace's table, else that of the shared one."""
    both = local.filter(F.col(key_col) == key).withColumn("__r", F.lit(0)).unionByName(shared.filter(F.col(key_col) == key).withColumn("__r", F.lit(1)))
    return both.orderBy("__r").limit(1).drop("__r")


def patched(rows: DataFrame, patches: DataFrame, key_col: str, cols: Sequence[str]) -> DataFrame:
    """``rows`` with the non-null values of ``patches``; everything else stays."""
    p = patches.select(key_col, *[F.col(c).alias(f"__{c}") for c in cols])
    out = rows.join(p, key_col, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in rows.columns])


def without(rows: DataFrame, gone: DataFrame, key_col: str) -> DataFrame:
    return rows.join(gone.select(key_col), key_col, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], many: int = 0) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same keys; ``many``, about how many rows both have, bounds what a task sorts."""
    cols = [c for c in old.columns if c not in keys]
    both = old.withColumn("__r", F.lit(0)).unionByName(new.withColumn("__r", F.lit(1)))
    last = spread(both, many, *keys).groupBy(*keys).agg(F.max_by(F.struct(*cols), "__r").alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in cols]).select(*old.columns)


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums of ``values`` over the rows of the same ``by`` that come before, under their names.

    Rows are sorted by range and written; sums of whole ranges come before those inside one, so a group
    may be larger than a task. Rows equal in ``order`` may change places. Null groups are groups.
    """
    named = {f"__{n}": v for n, v in values.items()}
    placed = rows.withColumns(named).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    placed = written(placed, "running")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda w: {n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in named}
    parts = placed.groupBy(*by, "__part").agg(*[F.sum(n).alias(n) for n in named]).withColumns(sums(before))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    p, q = placed.withColumns(sums(inside)).alias("p"), parts.alias("q")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in (*by, "__part")]
    joined = p.join(q, same)
    return joined.select(*[F.col(f"p.{c}") for c in rows.columns], *[(F.col(f"p.__{n}") + F.col(f"q.__{n}")).alias(n) for n in values])


def admit_within(rows: DataFrame, order: Sequence, tokens: Column, budget: int, by: Sequence[str]) -> DataFrame:
    """Rows whose running total before them is under the budget: the last may overshoot."""
    return running_sums(rows, by, order, {"__before": tokens}).filter(F.col("__before") < budget).drop("__before")


def recent(rows: DataFrame, by: Sequence[str], order_col: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.col(order_col).desc())
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def first_texts(rows: DataFrame, by: str, order_col: str, text_col: str, n: int, most_chars: int, between: str = " ") -> DataFrame:
    """``summary`` of each group: its ``n`` first texts that aren't empty, joined and cut; null for a group without any.

    A ranking keeps ``n`` rows of a group, so no group is gathered whole.
    """
    w = Window.partitionBy(by).orderBy(order_col)
    first = rows.filter(F.length(text_col) > 0).select(by, order_col, F.substring(text_col, 1, most_chars).alias("t")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)
    told = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x"))
    return rows.select(by).distinct().join(told, by, "left").select(by, F.substring(F.array_join(F.col("x.t"), between), 1, most_chars).alias("summary"))


#: Fixed value: what stands where a text was cut.
TRUNCATED = "\n\n--prompt truncated for brevity--\n\n"


def tokens_of(text: Column) -> Column:
    """Tokens of four characters; a null text has none."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def without_middle(text: Column, most: int, between: str = TRUNCATED) -> Column:
    """A text of at least ``most`` tokens with about so many left: what is cut stands around the middle, in whole tokens."""
    middle = F.floor(F.ceil(F.length(text) / 4) / 2)
    half = F.floor((tokens_of(text) - most + 1) / 2)
    left = F.substring(text, F.lit(1), (4 * F.greatest(F.lit(0), middle - half)).cast("int"))
    right = F.substring(text, (4 * (middle + half) + 1).cast("int"), F.length(text))
    return F.concat(left, F.lit(between), right)


#: Pairs that may be shortened, the share of the budget that a side may keep then, tokens that a shortened pair costs besides.
SHORTENED, SIDE, EXTRA = 3, 2.2, 11


def budgeted_history(chats: DataFrame, budget: int, by: str, order_col: str, user_col: str, assistant_col: str) -> DataFrame:
    """For each conversation the newest pairs within ``budget`` tokens, oldest first in ``place``.

    A pair is taken whole while the total stays below the budget. One of the three newest that overflows is shortened, and left
    out if it still doesn't fit; an older one that overflows ends the history. So three pairs a conversation are decided
    one after the other, in one row, and all older ones by their running sum. Null texts count as empty.
    """
    most = int(budget / SIDE)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    less = lambda c: F.when(tokens_of(c) > most, without_middle(c, most)).otherwise(c)
    pairs = chats.select(F.col(by).alias("by"), F.col(order_col).alias("order"), text(user_col).alias("user"), text(assistant_col).alias("assistant"))
    pairs = pairs.withColumn("cost", tokens_of(F.col("user")) + tokens_of(F.col("assistant")))
    pairs = running_sums(pairs, ["by"], [F.col("order").desc()], {"nth": F.lit(1), "older": F.col("cost")})
    newest = pairs.filter(F.col("nth") < SHORTENED).withColumns({"less_user": less(F.col("user")), "less_assistant": less(F.col("assistant"))})
    newest = newest.withColumn("less", tokens_of(F.col("less_user")) + tokens_of(F.col("less_assistant")) + EXTRA)
    costs = [F.max(F.when(F.col("nth") == i, F.struct("cost", "less"))).alias(f"p{i}") for i in range(SHORTENED)]
    used, fates = F.lit(0), []
    for i in range(SHORTENED):
        whole, less_cost = F.col(f"p{i}.cost"), F.col(f"p{i}.less")
        fate = F.when(used + whole < budget, "whole").when(used + less_cost <= budget, "less").otherwise("out")
        fates.append(fate)
        used = used + F.when(F.col(f"p{i}").isNull(), 0).when(fate == "whole", whole).when(fate == "less", less_cost).otherwise(0)
    decided = newest.groupBy("by").agg(*costs, F.sum("cost").alias("three")).select("by", "three", used.alias("used"), F.array(*fates).alias("fates"))
    joined = pairs.alias("p").join(decided.alias("d"), F.col("p.by").eqNullSafe(F.col("d.by"))).drop(F.col("d.by"))
    older = F.col("used") + F.col("older") - F.col("three") + F.col("cost") < budget
    fate = F.when(F.col("nth") >= SHORTENED, F.when(older, "whole").otherwise("out")).otherwise(F.get("fates", F.col("nth").cast("int")))
    kept = joined.withColumn("fate", fate).filter("fate <> 'out'")
    side = lambda c: F.when(F.col("fate") == "less", less(F.col(c))).otherwise(F.col(c)).alias(c)
    place = F.row_number().over(Window.partitionBy("by").orderBy("order")) - 1
    return kept.select(F.col("by").alias(by), place.alias("place"), F.col("order").alias(order_col), side("user"), side("assistant"))


def interval_speakers(segments: DataFrame, turns: DataFrame, by: str, bucket_s: float = 60.0) -> DataFrame:
    """``speaker`` of the largest overlap with each segment (by, seg_id, start, end); ties go to the earliest turn; none is ``Unknown``.

    Both sides are dealt by meeting and minute, so the range join is an equality join; a
    pair that shares several minutes is taken in the first one only.
    """
    minutes = lambda a, b: F.explode(F.sequence(F.floor(a / bucket_s), F.floor(b / bucket_s)))
    s = segments.select(by, "seg_id", "start", "end").withColumn("b", minutes(F.col("start"), F.col("end")))
    t = turns.select(by, F.col("start").alias("ts"), F.col("end").alias("te"), "speaker").withColumn("b", minutes(F.col("ts"), F.col("te")))
    pairs = s.join(t, [by, "b"]).filter((F.floor(F.greatest("start", "ts") / bucket_s) == F.col("b")) & (F.least("end", "te") > F.greatest("start", "ts")))
    best = pairs.groupBy(by, "seg_id").agg(F.max_by("speaker", F.struct(F.least("end", "te") - F.greatest("start", "ts"), -F.col("ts"))).alias("speaker"))
    return segments.join(best, [by, "seg_id"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("Unknown")))


def chunk_batches(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Frames of at most ``n`` rows, for models that take batches."""
    for frame in frames:
        for i in range(0, len(frame), n):
            yield frame.iloc[i : i + n]
