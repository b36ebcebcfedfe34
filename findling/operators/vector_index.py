"""A stored vector index: centroids beside a table that is partitioned by cell, searched without loss.

Every row lies in the cell of its nearest centroid and carries its distance to it. By the triangle inequality a row of a cell is
at least |distance of the query to the centroid - distance of the row to it| away, so cells are read by bounds: first a few near ones,
which give the distance that the k-th result has at most, then those that may hold something nearer; the others' files
are never opened, and inside a cell the scan is cut to a ring of distances that Parquet's statistics prune.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.functions import vectors as V
from findling.session import ship

#: Most cells of an index, rows that centroids are fitted on, rounds of fitting, and what rounding may do to a distance.
MOST_CELLS, SAMPLE, ROUNDS, SLACK = 4096, 50_000, 8, 1e-5


def _nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (centroids * centroids).sum(axis=1)
    cell = np.concatenate([(squares - 2 * v[a : a + 4096] @ centroids.T).argmin(axis=1) for a in range(0, len(v), 4096)] or [np.empty(0, np.int64)])
    return cell, np.sqrt(((v - centroids[cell]) ** 2).sum(axis=1))


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of a sample: evenly spaced rows, moved to the mean of their cell a few times."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        cell = _nearest(sample, centroids)[0]
        n = np.bincount(cell, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


class VectorIndex:
    """An index under ``path``, for distances of the metric ``l2`` or ``cosine``; ``cells_read`` tells what the last search opened."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding"):
        if metric not in ("l2", "cosine"):
            raise ValueError(f"no index for metric {metric}")
        self.spark, self.path, self.metric, self.id_col, self.vector_col = spark, path.rstrip("/"), metric, id_col, vector_col
        self.cells_read: list[int] = []

    def _place(self, rows: DataFrame) -> DataFrame:
        """Rows with the vector by which they lie in a cell: of length 1 for the cosine, so its order is that of distances."""
        v = V.as_double(F.col(self.vector_col))
        return rows.withColumn("place", V.normalise(v) if self.metric == "cosine" else v)

    def build(self, rows: DataFrame, cells: int | None = None) -> None:
        """Write the index of all ``rows``; those without a vector are left out. Centroids are fitted on at most SAMPLE rows.

        Without ``cells`` there is one for about every 1000 rows, the square root of their number at least, MOST_CELLS at most.
        """
        ship(self.spark)
        rows = self._place(rows.filter(F.col(self.vector_col).isNotNull()))
        n = rows.count()
        cells = max(1, min(MOST_CELLS, n, cells or max(math.isqrt(n), n // 1000)))
        share = min(1.0, 1.2 * SAMPLE / max(n, 1))
        picked = rows.select("place", F.xxhash64(self.id_col).alias("h")).filter(F.pmod("h", F.lit(1 << 30)) <= share * (1 << 30)).orderBy("h").limit(SAMPLE)
        # A bounded sample, and as many centroids as cells: both are parameters.
        sample = np.array([r["place"] for r in picked.collect()])
        centroids = fitted(sample, cells) if len(sample) else np.empty((0, 1))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.array(batch.column(batch.num_columns - 1).to_pylist()).reshape(batch.num_rows, -1)
                cell, away = _nearest(v, centroids)
                yield pa.record_batch([*batch.columns[:-1], pa.array(cell.astype(np.int32)), pa.array(away)], names=[*batch.schema.names[:-1], "cell", "away"])

        schema = T.StructType(rows.schema[:-1].fields).add("cell", T.IntegerType()).add("away", T.DoubleType())
        dealt = rows.mapInArrow(deal, schema)
        # Salted by the row, so that a large cell is written by several tasks, each sorted by distance.
        dealt = dealt.repartition("cell", F.pmod(F.xxhash64(self.id_col), F.lit(4))).sortWithinPartitions("cell", "away")
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{self.path}/rows")
        sizes = self.read().groupBy("cell").agg(F.min("away").alias("nearest"), F.max("away").alias("furthest"), F.count("*").alias("n"))
        places = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        places.join(sizes, "cell").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")

    def read(self, cells: Sequence[int] | None = None) -> DataFrame:
        """Rows of some cells; the others' folders are pruned."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows if cells is None else rows.filter(F.col("cell").isin(*cells))

    def search(self, query: Sequence[float], k: int, allowed: Sequence[str] | None = None, layer_col: str = "layer_id", first: int = 4, exact: bool = True) -> DataFrame:
        """As :func:`findling.operators.vector.top_k` over the indexed rows: the ``k`` nearest with ``distance`` and ``score``.

        ``first`` cells are read before there is a bound. With ``exact`` off, nothing is read after them.
        """
        from findling.operators.vector import top_k

        q = np.array(query, float)
        q = q / max(np.linalg.norm(q), 1e-10) if self.metric == "cosine" else q
        cells = sorted((float(np.linalg.norm(q - np.array(r["centroid"]))), r["cell"], r["nearest"], r["furthest"]) for r in self.spark.read.parquet(f"{self.path}/cells").collect())
        near = [c for _, c, _, _ in cells[:first]]
        found = top_k(self.read(near), query, k, self.metric, allowed, self.id_col, self.vector_col)
        self.cells_read = near
        best = [r["distance"] for r in found.select("distance").collect()] if exact else []
        if exact:
            # The k-th distance so far, as one between places: the square of that is twice the cosine distance.
            bound = math.inf if len(best) < k or best[-1] is None else math.sqrt(max(0.0, 2 * best[-1])) if self.metric == "cosine" else best[-1]
            bound += SLACK
            more = [(to, c) for to, c, nearest, furthest in cells[first:] if max(nearest - to, to - furthest) <= bound]
            self.cells_read = near + [c for _, c in more]
            if more:
                rings = self.read(self.cells_read)
                if math.isfinite(bound):
                    to = F.element_at(F.create_map(*[F.lit(x) for d, c, _, _ in cells if c in set(self.cells_read) for x in (c, d)]), F.col("cell"))
                    reach = max(d for d, c, _, _ in cells if c in set(self.cells_read)) + bound
                    rings = rings.filter((F.col("away") <= reach) & (F.abs(F.col("away") - to) <= bound))
                found = top_k(rings, query, k, self.metric, allowed, self.id_col, self.vector_col)
        return found.drop("cell", "away")
