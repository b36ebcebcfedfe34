"""Exact duplicates by sorting contents.

Rows are range-partitioned by sampled splitters over (first bytes of the
normalised text, a hash of the whole text, identifier), sorted externally inside
each partition by (those bytes, the hash, the text, identifier), and each text is
compared in full with its neighbour. The identifier is part of the splitters, so a
text that a third of all rows share spreads over many partitions; what a run of equal
texts has on either side of a partition's edge is joined by the length and SHA-256 of the
at most two edge texts of each partition. Splitters hold a bounded prefix, never whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from findling.llm.common import Columns
from findling.session import ship
from findling.storage import written

PREFIX_CHARS = 64


def _edge_key(text: str) -> bytes:
    """Length and SHA-256 of a text, 40 bytes however long it is."""
    content = text.encode()
    return len(content).to_bytes(8, "big") + hashlib.sha256(content).digest()


def _runs(id_col: str, carried: list[str], keep_type: pa.DataType, heads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Label runs of equal neighbours in a sorted partition.

    Of the open run, the carried columns are held back, with one copy of its text; where only ``heads`` of runs are
    wanted, its first row and a count are.
    """

    def emit(rows: pa.Table, lengths: np.ndarray, edge: int, text: str | None = None) -> Iterator[pa.RecordBatch]:
        """``rows`` are whole runs, or their heads."""
        if heads:
            of, size = np.arange(len(lengths)), lengths
        else:
            starts = np.cumsum(lengths) - lengths
            of, size = np.repeat(starts, lengths), np.repeat(lengths, lengths)
        n = len(of)
        out = {c: rows[c] for c in carried}
        out["pid"] = pa.array(np.full(n, TaskContext.get().partitionId(), dtype=np.int32))
        out["edge"] = pa.array(np.full(n, edge, dtype=np.int32))
        out["edge_key"] = pa.array([_edge_key(text), *[None] * (n - 1)] if edge else [None] * n, pa.binary())
        out["keep"] = rows[id_col].take(pa.array(of)).cast(keep_type)
        out["size"] = pa.array(size.astype(np.int64))
        out["head"] = pa.array(of == np.arange(n))
        yield from pa.table(out).combine_chunks().to_batches()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        length, open_text, first = 0, None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text = batch.column(batch.schema.get_field_index("text"))
            rows = batch.select(list(dict.fromkeys([*carried, id_col])))
            differs = np.flatnonzero(~np.asarray(pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False), dtype=bool)) + 1
            starts = np.concatenate([[0], differs]).astype(np.int64)
            lengths = np.diff(np.append(starts, n))
            at = 0
            if length and text[0].as_py() == open_text:
                length += int(lengths[0])
                if not heads:
                    held.append(rows.slice(0, int(lengths[0])))
                at = 1
            if at == len(starts):
                continue
            if length:
                yield from emit(pa.Table.from_batches(held), np.array([length]), int(first), open_text)
                first = False
            last = len(starts) - 1
            if first and at < last:
                run = rows.slice(int(starts[at]), 1 if heads else int(lengths[at]))
                yield from emit(pa.Table.from_batches([run]), lengths[at : at + 1], 1, text[int(starts[at])].as_py())
                first, at = False, at + 1
            if at < last:
                closed = pa.Table.from_batches([rows])
                closed = closed.take(pa.array(starts[at:last])) if heads else closed.slice(int(starts[at]), int(starts[last] - starts[at]))
                yield from emit(closed, lengths[at:last], 0)
            held = [rows.slice(int(starts[last]), 1 if heads else int(lengths[last]))]
            length, open_text = int(lengths[last]), text[int(starts[last])].as_py()
        if length:
            yield from emit(pa.Table.from_batches(held), np.array([length]), 1 if first else 2, open_text)

    return label


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    carry: list[str] | None = None,
    sha: str | None = None,
) -> DataFrame:
    """Every row of ``docs`` with the group of rows whose normalised text is equal.

    Adds ``keep_id`` (identifier of the row that stays), ``group_size`` and ``kept``.
    ``keep`` is ``smallest`` or ``largest``. ``carry`` names the columns to return
    (all by default); ``sha`` names an extra column for the SHA-256 of the normalised text.

    Null texts count as empty and form one group with empty ones. A null identifier
    comes after all others, so it stays only where its group has nothing else. Of rows
    repeated with the same identifier exactly one is kept. Identifiers may have any type that has an order. Very long
    texts are compared whole. An empty table gives an empty result. Columns may have any names; those called like the
    added ones, in any case, are replaced.
    """
    own = Columns(docs, ["keep_id", "group_size", "kept", *([sha] if sha else [])])
    kept = own.kept if carry is None else [c for c in map(own.at, carry) if c in own.kept]
    rows = _labelled(own.table, own.at(id_col), own.at(text_col), kept, keep, normalise, bool(sha), False)
    return rows.select(*[F.col(c).alias(own.named(c)) for c in kept], "keep_id", "group_size", "kept", *([F.col("digest").alias(sha)] if sha else []))


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, with the columns of ``docs``."""
    own = Columns(docs)
    rows = _labelled(own.table, own.at(id_col), own.at(text_col), own.kept, keep, normalise, False, True)
    return rows.filter("kept").select(*own.all())


def _labelled(table: DataFrame, id_col: str, text_col: str, carried: list[str], keep: str, normalise: Callable[[Column], Column] | None, sha: bool, heads: bool) -> DataFrame:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    ship(table.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    best = F.col(id_col).asc_nulls_last() if keep == "smallest" else F.col(id_col).desc_nulls_last()
    wanted = list(dict.fromkeys([*carried, id_col]))
    keyed = table.select(*wanted, text.alias("text"))
    keyed = keyed.withColumns({"prefix": F.substring("text", 1, PREFIX_CHARS), "hash": F.xxhash64("text")})
    ordered = keyed.repartitionByRange("prefix", "hash", best).sortWithinPartitions("prefix", "hash", "text", best)
    ordered = ordered.select(*wanted, "text", *([F.sha2("text", 256).alias("digest")] if sha else []))
    out = [*carried, *(["digest"] if sha else [])]
    kind = ordered.schema[id_col].dataType
    schema = T.StructType([ordered.schema[c] for c in out])
    for name, added in (("pid", T.IntegerType()), ("edge", T.IntegerType()), ("edge_key", T.BinaryType()), ("keep", kind), ("size", T.LongType()), ("head", T.BooleanType())):
        schema = schema.add(name, added)
    runs = written(ordered.mapInArrow(_runs(id_col, out, to_arrow_type(kind), heads), schema), "exact-runs")
    edge = runs.filter(F.col("edge_key").isNotNull()).select("pid", "edge", "edge_key", "keep", "size")
    joined = edge.groupBy("edge_key").agg(F.min("pid").alias("first"), F.min_by("keep", "pid").alias("all_keep"), F.sum("size").alias("all_size"))
    # At most two rows of some 100 bytes for each partition of the sort: bounded by the number of partitions, not by the data.
    edges = F.broadcast(edge.join(joined, "edge_key").select("pid", "edge", "first", "all_keep", "all_size"))
    whole = runs.drop("edge_key").join(edges, ["pid", "edge"], "left")
    at_edge = F.col("first").isNotNull()
    return whole.select(
        *out,
        F.when(at_edge, F.col("all_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(at_edge, F.col("all_size")).otherwise(F.col("size")).alias("group_size"),
        (F.col("head") & (~at_edge | (F.col("first") == F.col("pid")))).alias("kept"),
    )


__all__ = ["exact_dedup", "unique_documents"]
