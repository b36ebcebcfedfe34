"""Search over vector tables: exact top-k behind access filters, fusion, joins by similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.functions import vectors as V
from findling.session import ship
from findling.storage import written

PUBLIC_LAYERS = ("default", "public")
#: Rows of a block, or classes of a type with one pivot, and the most pivots.
BLOCK, MAX_PIVOTS = 1000, 1024
#: In the join by similarity: classes of a block, and rows compared with one at a time.
PAIR, STRIP = 4096, 512


def prefilter(chunks: DataFrame, allowed: Sequence[str] | None = None, layer_col: str = "layer_id") -> DataFrame:
    """Rows of the allowed layers; without any, those of the public ones. Stands before every ranking."""
    return chunks.filter(F.col(layer_col).isin(*(allowed or PUBLIC_LAYERS)))


def top_k(chunks: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", allowed: Sequence[str] | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows with ``distance`` and ``score`` = 1 - distance; ties by identifier.

    Each task keeps its best ``k``; nothing is shuffled but those.
    """
    if k < 1:
        raise ValueError("k must be positive")
    target = F.lit([float(x) for x in query])
    scored = prefilter(chunks, allowed).withColumn("distance", V.distance(metric, F.col(vector_col), target))
    return scored.withColumn("score", 1 - F.col("distance")).orderBy(F.col("distance").asc_nulls_last(), id_col).limit(k)


def threshold_search(chunks: DataFrame, query: Sequence[float], k: int = 4, least: float = 0.25, pinned: DataFrame | None = None, strict: bool = True, **options) -> DataFrame:
    """Top-k first, then the threshold and the pinned rows: fewer than ``k`` may remain."""
    id_col = options.get("id_col", "vec_id")
    found = top_k(chunks, query, k, **options).withColumn("score", V.similarity(F.col("distance"), strict))
    found = found.filter(F.col("score") >= least)
    return found if pinned is None else found.join(pinned.select(id_col), id_col, "left_anti")


def federated_search(parts: Sequence[DataFrame], query: Sequence[float], k: int, id_col: str = "vec_id", **options) -> DataFrame:
    """The best ``k`` over several tables, each searched on its own."""
    found = [top_k(p, query, k, id_col=id_col, **options) for p in parts]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(F.col("score").desc(), id_col).limit(k)


def reciprocal_rank_fusion(lists: Sequence[tuple[DataFrame, Column]], id_col: str = "id", k: int = 60) -> DataFrame:
    """``id_col``, ``rrf`` = sum of 1 / (k + rank + 1) over the lists that hold it, and ``source``, the first of them.

    Each list is (rows, order); ranks start at 0. Rows without identifier are skipped. Lists
    are results of searches, so a window over each is small.
    """
    ranked = None
    for i, (rows, order) in enumerate(lists):
        w = Window.orderBy(order, id_col)
        part = rows.filter(F.col(id_col).isNotNull()).select(id_col, (F.row_number().over(w) - 1).alias("rank"), F.lit(i).alias("source"))
        ranked = part if ranked is None else ranked.unionByName(part)
    fused = ranked.groupBy(id_col).agg(F.sum(1 / (F.lit(k) + F.col("rank") + 1)).alias("rrf"), F.min(F.struct("source", "rank")).alias("first"))
    return fused.select(id_col, "rrf", F.col("first.source").alias("source"), F.col("first.rank").alias("rank"))


def rerank(candidates: DataFrame, k: int, logit_col: str | None = None, fallback_col: str = "score", id_col: str = "id") -> DataFrame:
    """By the sigmoid of a model's logit, or of the given score where there is none; no model passes ``k`` through."""
    score = F.col(fallback_col) if logit_col is None else F.coalesce(V.sigmoid(F.col(logit_col)), F.col(fallback_col))
    return candidates.withColumn("rerank_score", score).orderBy(F.col("rerank_score").desc_nulls_last(), id_col).limit(k)


def similarity_matrix(rows: DataFrame, queries: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``dot`` of every row (``a``) with every query (``b``): a stated set of queries against all rows, in blocks.

    Queries and rows are dealt to blocks of about BLOCK, and each block of rows meets each of queries in one matrix product, so
    a task holds BLOCK squared products at a time; rows are copied once for each block of queries, queries once for each block of rows. Null vectors have no row.
    """
    spark = rows.sparkSession
    ship(spark)
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    kind, asked = rows.schema[id_col].dataType, queries.schema[id_col].dataType
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / BLOCK))
    left = rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("a"), V.as_double(F.col(vector_col)).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"))
    left = left.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("b"), V.as_double(F.col(vector_col)).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("blk"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = T.StructType([T.StructField("a", kind), T.StructField("b", asked), T.StructField("dot", T.DoubleType())])

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = x["a"].combine_chunks(), y["b"].combine_chunks()
        if not len(a) or not len(b):
            return pa.table([a.slice(0, 0), b.slice(0, 0), pa.array([], pa.float64())], names=["a", "b", "dot"])
        dots = np.array(x["v"].to_pylist()) @ np.array(y["v"].to_pylist()).T
        i, j = np.divmod(np.arange(dots.size), len(b))
        return pa.table([a.take(pa.array(i)), b.take(pa.array(j)), pa.array(dots.ravel())], names=["a", "b", "dot"])

    return left.groupBy("part", "blk").cogroup(right.groupBy("part", "blk")).applyInArrow(compare, out)


def _unit(v: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of length 1."""
    if not len(v):
        return np.empty((0, 1))
    if len(pc.unique(pc.list_value_length(v))) > 1:
        raise ValueError("vectors of one type must have one length")
    m = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def similarity_join(rows: DataFrame, least: float = 0.95, type_col: str = "type", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Links (source_id later, target_id earlier) of one type with cosine >= ``least``.

    Equal vectors of a type are one class, named by its smallest identifier: classes give all their pairs, and each
    copy is linked with its class only, so a vector that many rows share gives no square of links. Types with over
    BLOCK classes get sampled pivots (at most about MAX_PIVOTS in all, so broadcasting them is bounded). A vector
    belongs to its nearest pivot, and visits an earlier one only if the plane between the two is no farther than two
    linked vectors may be; the bound is exact, so no link is lost. Visits are counted before any vector moves: where
    they would send more than all pairs of blocks do, as in many dimensions without clusters, the type is one cell. Cells are compared in
    pairs of blocks of about PAIR, by matrix products that return links only; each vector is sent once for a block of its cell.
    Null and zero vectors and null identifiers have no links; null types are a type.
    """
    spark = rows.sparkSession
    ship(spark)
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    given = rows.select(F.col(type_col).alias("type"), F.col(id_col).alias("id"), F.col(vector_col).alias("raw")).filter("id IS NOT NULL AND raw IS NOT NULL")
    classes = given.filter(V.norm(F.col("raw")) > 0).groupBy("type", "raw").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    classes = written(classes, "vector-classes")
    # As given, for floats are half of doubles.
    unit = classes.select("type", F.col("rep").alias("id"), F.col("raw").alias("v"))
    counts = written(unit.groupBy("type").count(), "vector-types")
    total = counts.agg(F.sum("count")).first()[0] or 0
    share = max(BLOCK, math.ceil(total / MAX_PIVOTS))
    larger = counts.filter(F.col("count") > share)
    nth = Window.partitionBy("type").orderBy("salted", "id")
    # The few with the smallest hashes; only those reach the window.
    drawn = unit.join(larger.withColumnRenamed("type", "t"), F.col("type").eqNullSafe(F.col("t")))
    drawn = drawn.withColumn("salted", F.abs(F.xxhash64("id") / F.lit(2.0**63))).filter(F.col("salted") * F.col("count") < 2 * F.ceil(F.col("count") / share) + 10)
    drawn = drawn.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= F.ceil(F.col("count") / share))
    pivots: dict = {}
    for r in drawn.select("type", "nth", V.normalise(F.col("v")).alias("v")).orderBy("type", "nth").collect():
        pivots.setdefault(r["type"], []).append(r["v"])
    kind, kind_t = rows.schema[id_col].dataType, rows.schema[type_col].dataType

    def visited(batch: pa.RecordBatch, held: dict) -> Iterator[tuple]:
        """Of a type's rows in a batch: the type, the rows, their own cells, and which other cells they visit; without pivots, none."""
        of: dict = {}
        for i, t in enumerate(batch.column(0).to_pylist()):
            of.setdefault(t, []).append(i)
        for t, at in of.items():
            p = held.get(t)
            if p is None:
                yield t, np.array(at), np.zeros(len(at), int), np.zeros((len(at), 1), bool)
                continue
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * p @ p.T))
            for s in range(0, len(at), STRIP):
                rows_now = np.array(at[s : s + STRIP])
                near = _unit(batch.column(2).take(pa.array(rows_now))) @ p.T
                own = near.argmax(axis=1)
                also = near[np.arange(len(own)), own][:, None] - near <= reach * apart[own] + 1e-6
                yield t, rows_now, own, also & (np.arange(len(p)) < own[:, None])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict = {}
            for t, _, own, also in visited(batch, drawn_pivots.value):
                if t in drawn_pivots.value:
                    n[t] = n.get(t, 0) + np.bincount(own, minlength=also.shape[1]) + also.sum(axis=0)
            types, cell, many = [t for t, x in n.items() for _ in x], [c for x in n.values() for c in range(len(x))], [int(y) for x in n.values() for y in x]
            yield pa.record_batch([pa.array(types, batch.column(0).type), pa.array(cell, pa.int32()), pa.array(many, pa.int64())], names=["t", "c", "n"])

    size = T.StructType([T.StructField("t", kind_t), T.StructField("c", T.IntegerType()), T.StructField("n", T.LongType())])
    sent, cells_of, kept = {}, [], {}
    if pivots:
        drawn_pivots = spark.sparkContext.broadcast({t: np.array(v) for t, v in pivots.items()})
        # As many rows as there are pivots.
        found_cells = unit.mapInArrow(counted, size).groupBy("t", "c").agg(F.sum("n").alias("n")).filter("n > 0").collect()
        whole = {r["type"]: r["count"] for r in larger.collect()}
        for t, _, n in found_cells:
            sent[t] = sent.get(t, 0) + n * math.ceil(n / PAIR)
        kept = {t: np.array(v) for t, v in pivots.items() if sent.get(t, 0) < whole[t] * math.ceil(whole[t] / PAIR)}
        cells_of = [tuple(r) for r in found_cells if r["t"] in kept]
    held = spark.sparkContext.broadcast(kept)
    alone = counts.select(F.col("type").alias("t"), F.lit(0).alias("c"), F.col("count").alias("n"))
    if kept:
        cut = spark.createDataFrame(cells_of, size)
        gone = cut.select(F.col("t").alias("g")).distinct()
        alone = alone.join(gone, F.col("t").eqNullSafe(F.col("g")), "left_anti").unionByName(cut)
    sizes = written(alone.select("t", "c", F.ceil(F.col("n") / PAIR).cast("int").alias("blocks"), "n"), "vector-cells")
    moved = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    cells = T.StructType([T.StructField("type", kind_t), T.StructField("id", kind), T.StructField("v", rows.schema[vector_col].dataType), T.StructField("home", T.IntegerType()), T.StructField("cell", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, own, also in visited(batch, held.value):
                row, other = np.nonzero(also)
                row, cell = np.concatenate([np.arange(len(at)), row]), np.concatenate([own, other])
                rows_now = batch.take(pa.array(at[row]))
                yield pa.record_batch([*rows_now.columns, pa.array(own[row], pa.int32()), pa.array(cell, pa.int32())], names=[*batch.schema.names, "home", "cell"])

    placed = unit.mapInArrow(place, cells) if kept else unit.withColumns({"home": F.lit(0), "cell": F.lit(0)})
    split = placed.join(sizes.drop("n"), F.col("type").eqNullSafe(F.col("t")) & (F.col("cell") == F.col("c"))).drop("t", "c")
    split = split.withColumn("blk", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumns({"a": F.least("blk", "other"), "b": F.greatest("blk", "other")})
    links = T.StructType([T.StructField("type", kind_t), T.StructField("source_id", kind), T.StructField("target_id", kind), T.StructField("similarity", T.DoubleType())])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        cell, a, b = key[1].as_py(), key[2].as_py(), key[3].as_py()
        ids, home, blk = table["id"].combine_chunks(), table["home"].to_numpy(), table["blk"].to_numpy()
        v = _unit(table["v"].combine_chunks())
        left, right = np.flatnonzero(blk == a), np.flatnonzero(blk == b)
        near = v[right].T
        met = [(np.empty(0, int), np.empty(0, int))]
        for s in range(0, len(left) if len(right) else 0, STRIP):
            i, j = np.nonzero(v[left[s : s + STRIP]] @ near >= least)
            i, j = left[s + i], right[j]
            # Two visitors of a cell meet elsewhere; inside one block each pair is met twice.
            one = ((home[i] == cell) | (home[j] == cell)) & ((i < j) if a == b else True)
            met.append((i[one], j[one]))
        i, j = (np.concatenate(x) for x in zip(*met, strict=True))
        p, q = ids.take(pa.array(i)), ids.take(pa.array(j))
        later = pc.greater(p, q)
        cosine = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", v[i[s : s + PAIR]], v[j[s : s + PAIR]]) for s in range(0, len(i), PAIR))])
        types = table["type"].combine_chunks().take(pa.array(i))
        return pa.table([types, pc.if_else(later, p, q), pc.if_else(later, q, p), pa.array(cosine, pa.float64())], names=["type", "source_id", "target_id", "similarity"])

    # Groups are much work for their bytes, so tasks that take many aren't wanted.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, math.ceil(moved / (16 * PAIR)))
    pairs = split.select("type", "cell", "a", "b", "blk", "home", "id", "v").repartition(parts, "type", "cell", "a", "b")
    found = pairs.groupBy("type", "cell", "a", "b").applyInArrow(compare, links)
    several = classes.filter("rows > 1").select(F.col("type").alias("t"), F.col("raw").alias("r"), "rep")
    copies = given.join(several, F.col("type").eqNullSafe(F.col("t")) & (F.col("raw") == F.col("r"))).filter("id <> rep")
    return found.unionByName(copies.select("type", F.col("id").alias("source_id"), F.col("rep").alias("target_id"), F.lit(1.0).alias("similarity")))
