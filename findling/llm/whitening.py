"""Whitening of embeddings: principal components by blockwise QR and a bidiagonal qd solver.

1. Vectors become whole numbers; their sums are exact, so centring costs one rounding a component.
2. Every task folds its centred rows, block by block, into one upper triangle R (Householder QR), and triangles are
   folded together in a tree of tasks. R^T R is the matrix of centred products, but R was never squared, so small
   components keep their digits.
3. R is as large as the dimension squared. The driver makes it bidiagonal, dqds gives the singular values and
   twisted factorisations the components (:mod:`findling.llm.bidiagonal`).
4. A last pass projects every row. The covariance of the result comes from moments that are centred in each block and merged in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.llm.bidiagonal import right_vectors
from findling.llm.common import Columns
from findling.session import ship
from findling.storage import written

#: Rows in a block, partial results that one task folds together, and the most components a vector may have.
BLOCK, FAN_IN, MOST_DIMENSIONS = 4096, 32, 4096
SCALE, SHIFT = 1024, 100_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Whole-number vectors as rows; what a vector lacks is the number of a zero."""
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    if len(flat) == dim * len(column) and np.array_equal(at, np.arange(len(column) + 1) * dim):
        return flat.reshape(-1, dim)
    out, lengths = np.full((len(column), dim), SHIFT, np.int64), np.diff(at)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(at[:-1], lengths)] = flat
    return out


def _folded(parts: DataFrame, fold: Callable[[list[np.ndarray]], np.ndarray], name: str) -> np.ndarray | None:
    """One array from rows of arrays (``part``), in a tree of tasks; None where there are no rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[np.ndarray] = []
        for batch in batches:
            for i in range(batch.num_rows):
                state = [fold([*state, batch.column(0)[i].values.to_numpy()])]
        yield pa.record_batch([pa.array([state[0]] if state else [], pa.list_(pa.float64()))], names=["part"])

    while True:
        parts = written(parts, name)
        n = parts.count()
        if n <= 1:
            break
        # Arrays of a task of the dimension squared, so they are dealt by count.
        parts = parts.repartition(max(1, -(-n // FAN_IN))).mapInArrow(work, "part array<double>")
    row = parts.first()
    return None if row is None else np.array(row["part"])


def _triangle(blocks: list[np.ndarray], dim: int) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r") if blocks else np.empty((0, dim))


def _triangles(dim: int, n: int, sums: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for a in range(0, len(x), BLOCK):
                r = _triangle([r, _centred(x[a : a + BLOCK], n, sums)], dim)
        if len(r):
            yield pa.record_batch([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part"])

    return work


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: the numerator is whole, so there is one rounding."""
    return (n * x - sums) / n


def _projected(dim: int, n: int, sums: np.ndarray, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1), dim)
            y = _centred(x, n, sums) @ weights
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.record_batch([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], "white"])

    return work


def merged_moments(parts: list[np.ndarray]) -> np.ndarray:
    """Moments (count, means, centred products) of several sets as those of all."""
    a, *rest = parts
    k = int(np.sqrt(len(a)))
    for b in rest:
        n, m = a[0], b[0]
        delta = b[1 : k + 1] - a[1 : k + 1]
        mean = a[1 : k + 1] + delta * (m / (n + m))
        products = a[k + 1 :] + b[k + 1 :] + np.outer(delta, delta).ravel() * (n * m / (n + m))
        a = np.concatenate([[n + m], mean, products])
    return a


def _moments(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column(0).flatten().to_numpy().reshape(-1, k)
            mean = w.mean(axis=0)
            state = [merged_moments([*state, np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])])]
        yield pa.record_batch([pa.array(state, pa.list_(pa.float64()))], names=["part"])

    return work


class Whitening:
    """What :func:`fit_whitening` learns: count, exact sums and components (columns) with their eigenvalues and shares of the variance."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, components: np.ndarray, explained: np.ndarray):
        self.n, self.sums, self.values, self.components, self.explained = n, sums, values, components, explained


def whole_vectors(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with ``x``: its vectors as floor(1024 c) + 100000; rows without a usable vector go."""
    c = F.col(vector).cast("array<double>")
    good = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(good).withColumn("x", F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + SHIFT))


def fit_whitening(rows: DataFrame, most: int = 8) -> Whitening:
    """Fit on the column ``x`` of all rows: the ``most`` largest components that are no rounding noise."""
    sums = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v") - SHIFT).alias("s"))
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {dim} components, at most {MOST_DIMENSIONS} are fitted")
    total = np.full(dim, n * SHIFT, np.int64)
    # As many rows as a vector has components.
    for r in sums.collect():
        total[r["at"]] += r["s"]
    parts = rows.select("x").mapInArrow(_triangles(dim, n, total), "part array<double>")
    flat = _folded(parts, lambda some: _triangle([p.reshape(-1, dim) for p in some], dim).ravel(), "white-triangles")
    r = np.zeros((dim, dim))
    if flat is not None:
        top = flat.reshape(-1, dim)
        r[: len(top)] = top
    squares, components = right_vectors(r, most)
    trace = (r * r).sum()
    return Whitening(n, total, squares / max(n, 1), components, squares / trace if trace else squares)


def whiten(df: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each row's identifier, ``n``, ``deviation``, ``white`` (whitened components, largest variance first), ``explained`` and ``identity_error``.

    The fit takes all rows whose vector is not null and holds no null, NaN or infinite component; the others are dropped. Repeated rows and
    identifiers and null identifiers count like any other. A vector with fewer components than the longest counts as ended by
    zeros. Fewer than ``most`` components are returned where the rest has no variance (equal rows or one row: none). An empty table
    gives an empty result. ``deviation`` sums (n x - S)^2 in whole numbers and fails, rather than round, where that passes 63 bits.
    Other columns are ignored, whatever their names.
    """
    ship(df.sparkSession)
    own = Columns(df)
    rows = whole_vectors(own.table, own.at(vector_col)).select(F.col(own.at(id_col)).alias("id"), "x")
    rows = written(rows, "white-rows")
    fit = fit_whitening(rows, most)
    dim, k = len(fit.sums), len(fit.values)
    # As long as a vector.
    sums = F.lit(fit.sums.tolist()).cast("array<long>")
    padded = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dim) - F.size("x")))
    apart = F.zip_with(padded, sums, lambda x, s: (x * fit.n - s) * (x * fit.n - s))
    source = rows.select("id", F.aggregate(apart, F.lit(0).cast("long"), lambda a, v: a + v).alias("deviation"), "x")
    schema = source.schema[:-1].add("white", T.ArrayType(T.DoubleType()))
    white = written(source.mapInArrow(_projected(dim, fit.n, fit.sums, fit.components / np.sqrt(fit.values)), schema), "white-result")
    moments = _folded(white.select("white").mapInArrow(_moments(k), "part array<double>"), merged_moments, "white-moments") if k else None
    error = None if moments is None else float(np.abs(moments[k + 1 :].reshape(k, k) / moments[0] - np.eye(k)).max())
    return white.select(
        F.col("id").alias(id_col),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "white",
        F.lit(fit.explained.tolist()).cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
