"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findling.storage import written

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of the longest word that a worker remembers something about: times the number of words, that bounds a memory.
REMEMBERED = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Columns:
    """A table's columns by place, so that helper columns clash with none, whatever its columns are called.

    ``table`` has the columns ``in_0``, ``in_1`` and so on. ``replaced`` are names that the result adds: columns of
    these names, in any case, are left out of ``own``, which gives the others their names back. A select with ``own`` holds
    plain columns beside it only: in a lambda, a name may be taken for one that the same select gives.
    """

    def __init__(self, docs: DataFrame, replaced: Iterable[str] = ()):
        self.names = docs.columns
        self.table = docs.toDF(*[f"in_{i}" for i in range(len(self.names))])
        gone = {n.lower() for n in replaced}
        self.kept = [f"in_{i}" for i, n in enumerate(self.names) if n.lower() not in gone]

    def at(self, name: str) -> str:
        """The place of a column; its exact name goes before one in another case."""
        if name in self.names:
            return f"in_{self.names.index(name)}"
        lower = [n.lower() for n in self.names]
        if name.lower() not in lower:
            raise ValueError(f"there is no column {name}")
        return f"in_{lower.index(name.lower())}"

    def named(self, place: str) -> str:
        return self.names[int(place[3:])]

    def own(self) -> list[Column]:
        """The kept columns under their names."""
        return [F.col(p).alias(self.named(p)) for p in self.kept]

    def all(self) -> list[Column]:
        """All columns under their names."""
        return [F.col(f"in_{i}").alias(n) for i, n in enumerate(self.names)]


def digest_key(seed: str, column: Column) -> Column:
    """60 bits that look random and are the same in every engine that has MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, order: list, name: str, table: str) -> DataFrame:
    """``df`` with ``name``: the place of each row, from 0, in the given order, which must be total but for equal rows.

    Rows are sorted by range and written; a row's place is the count of rows in the partitions before plus its place in
    its own, so no task sees more than a range.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("placed", F.monotonically_increasing_id())
    placed = written(placed, table).withColumns({"part": F.shiftright("placed", 33), "nth": F.col("placed").bitwiseAND(F.lit((1 << 33) - 1))})
    # As many rows as the sort has partitions.
    parts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    parts = parts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(parts), "part").withColumn(name, F.col("before") + F.col("nth")).drop("placed", "part", "nth", "before")
