"""Mixing sources to target weights.

Every row gets a hash-random key. The leading bits of that key cut the range of keys
into ranges of equal width, which for uniform keys are what sampled splitters would
give; rows are sorted by key within (source, range), and a prefix sum over the sizes of
ranges plus a prefix sum inside a range is the running number of words in the source's
random order, without any source passing through one task. A source's budget is cut from
that order: whole epochs first, then up to the exact word of the last one.
All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findling.llm.common import WORD, Columns, digest_key, n_words
from findling.storage import written

#: Rows of all sources that share a range of keys, on average, and the most ranges: beyond 500 million rows ranges
#: hold more rows, which changes no result.
RANGE_ROWS, MAX_RANGE_BITS = 500, 20
KEY_BITS = 60
ROW_MASK = (1 << 33) - 1
ADDED = ("size", "source_size", "target", "taken")


def source_targets(sources: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """``source_key``, ``source_size`` -> with ``weight`` and ``target``, one row a source.

    Weights go round by the order of ``source_key``. Sources whose share of the sum of sizes, by weight, is above
    ``max_epochs`` times their size are set to that, and the rest is shared again, until none is above. Sources may be
    many: their order comes from a sort by range and counts of its partitions, and each round is an aggregate.
    """
    ordered = sources.repartitionByRange("source_key").sortWithinPartitions("source_key").withColumn("place", F.monotonically_increasing_id())
    ordered = written(ordered, "mix-sources").withColumns({"part": F.shiftright("place", 33), "nth": F.col("place").bitwiseAND(F.lit(ROW_MASK))})
    # As many rows as the sort has partitions.
    parts = ordered.groupBy("part").agg(F.count("*").alias("rows"))
    parts = parts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("first") + F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    s = ordered.join(F.broadcast(parts), "part").select("source_key", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    s = written(s, "mix-weights")
    total, n_capped, level = float(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]), -1, 0.0
    while True:
        above = F.lit(level) * F.col("weight") > F.col("cap")
        capped, held, free = s.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if capped == n_capped or not free:
            break
        n_capped, level = capped, (total - held) / free
    return s.select("source_key", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``.

    ``size`` is the number of words, ``taken`` how many of them the mix takes, repeats
    counted: whole copies and, for the one document of a source at which its budget
    ends, the words of its beginning that fill it. Budgets are targets without their
    fraction, so the taken words of a source differ from its target by less than one. ``carry`` names the columns to
    return (all by default); what is carried is written once with the sizes, so texts are scanned once.

    The order within a source follows a hash of ``seed`` and the identifier, so reruns
    agree. Null and empty texts have size 0 and take 0. The null source is a source, the
    last one. Rows with the same identifier (or none) are ordered by a hash of their text;
    rows equal in all of it may change places. An empty table gives an empty result.
    Columns may have any names; those called like the added ones, in any case, are replaced.
    """
    own = Columns(docs, ADDED)
    kept = own.kept if carry is None else [own.at(c) for c in carry]
    rows = _mixed(own, kept, weights, max_epochs, seed, id_col, text_col, source_col)
    return rows.select(*[F.col(c).alias(own.named(c)) for c in kept], *ADDED)


def _mixed(own: Columns, kept: Sequence[str], weights: Sequence[float], max_epochs: int, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text, source, ident = F.col(own.at(text_col)), F.col(own.at(source_col)), F.col(own.at(id_col))
    keyed = own.table.select(
        *kept,
        ident.alias("ident"),
        n_words(text).alias("size"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string"))).alias("source_key"),
        digest_key(seed, ident).alias("key"),
        F.xxhash64(text).alias("tie"),
    )
    keyed = written(keyed, "mix-rows")
    bits = min(MAX_RANGE_BITS, max(4, math.ceil(math.log2(keyed.count() / RANGE_ROWS + 1))))
    keyed = keyed.withColumn("range", F.shiftright("key", KEY_BITS - bits).cast("int"))
    cells = written(keyed.groupBy("source_key", "range").agg(F.sum("size").alias("cell")), "mix-cells")
    targets = source_targets(cells.groupBy("source_key").agg(F.sum("cell").alias("source_size")), weights, max_epochs)
    upto = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source_key", "range", F.coalesce(F.sum("cell").over(upto), F.lit(0)).alias("before"))
    # Sources and cells grow with the rows, so their joins merge.
    cells = cells.join(targets.hint("merge"), "source_key")
    inside = Window.partitionBy("source_key", "range").orderBy("key", "ident", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = keyed.withColumn("upto", F.sum("size").over(inside)).join(cells.hint("merge"), ["source_key", "range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    before = F.col("before") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.withColumn("taken", (epochs * F.col("size") + part).cast("long"))


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    copy: str | None = None,
) -> DataFrame:
    """The mix itself: a row for each copy, with the columns of ``docs``; ``copy`` names a column for the copy's number, from 1.

    A copy that the budget cuts holds the beginning of the text up to its last word taken. Nulls, ties, repeated rows,
    empty tables and names are as for :func:`mix_sources`, but no column is replaced, unless it is called ``copy``.
    """
    own = Columns(docs, [copy] if copy else [])
    place = own.at(text_col)
    mixed = _mixed(own, list(dict.fromkeys([*own.kept, place])), weights, max_epochs, seed, id_col, text_col, source_col)
    copies = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    one = mixed.filter(F.col("taken") > 0).withColumn("nth", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("nth") - 1) * F.col("size"))
    pieces = F.regexp_extract_all(F.col(place), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, words.cast("int")), "")
    text = F.when(words == F.col("size"), F.col(place)).otherwise(cut)
    number = [F.col("nth").alias(copy)] if copy else []
    return one.select(*[(text if c == place else F.col(c)).alias(own.named(c)) for c in own.kept], *number)
