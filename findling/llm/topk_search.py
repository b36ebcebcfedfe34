"""Exact search for the largest inner products, by buckets of vectors of like length.

1. Equal vectors are searched for once, and of equal candidates only as many as a result may hold take part.
2. Some of the longest candidates, a bounded number, give every query a first threshold: its k-th score there.
3. Candidates are dealt into buckets: levels of length, cut by a hash into parts of bounded size. A query
   is sent only to levels that are long enough: |query| x |candidate| bounds a score.
4. In a bucket a query's threshold becomes a local one, the cosine that a candidate as long as the bucket's longest
   needs. Where it is high, the candidate's angle to the axis of one of the query's large coordinates must lie within
   that cosine's angle of the query's own, so a range of the bucket's sorted coordinates is looked up (coordinate pruning);
   elsewhere the bucket's longest candidates are taken (length pruning). What is left is verified by its product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findling.llm.common import Columns
from findling.session import ship
from findling.storage import written

#: Levels of length for each factor of two; candidates and queries of one bucket, on average; longest candidates for the first threshold.
LEVELS, CANDIDATES, QUERIES, LONGEST = 8, 8192, 1024, 2048
#: From this local cosine on a bucket's sorted coordinates are looked up, those of the query's largest ones.
COORDINATE_FROM, FOCUS = 0.5, 3
#: Level of vectors without a length, below that of any other.
NOWHERE = -20_000
#: Products below this are whole in single precision.
SINGLE = 1 << 24
#: What rounding may do to a length or an angle.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _length(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


class Bucket:
    """Candidates of one bucket, longest first, with the coordinates of their directions in order."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        length = _length(vectors)
        order = np.lexsort((rows, ids, -length))
        self.vectors, self.ids, self.rows, self.length = vectors[order], ids[order], rows[order], length[order]
        self.directions = self.vectors / np.maximum(self.length, 1e-300)[:, None]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.looked_up = self.verified = 0

    def _coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._sorted:
            by = np.argsort(self.directions[:, f])
            self._sorted[f] = self.directions[by, f], by
        return self._sorted[f]

    def _in_range(self, query: np.ndarray, length: float, cosine: float, most: int) -> np.ndarray | None:
        """Places within the angle of ``cosine`` on the axes of the query's largest coordinates, if one axis leaves fewer than ``most``."""
        unit, least, ranges = query / length, None, []
        angle = math.acos(min(1.0, cosine)) + SLACK
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            own = math.acos(max(-1.0, min(1.0, float(unit[f]))))
            low, high = math.cos(min(math.pi, own + angle)) - SLACK, math.cos(max(0.0, own - angle)) + SLACK
            ranges.append((f, low, high))
            values, by = self._coordinate(f)
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if b - a < most:
                most, least = int(b - a), by[a:b]
        if least is None:
            return None
        near = self.directions[least]
        within = np.all([(near[:, f] >= low) & (near[:, f] <= high) for f, low, high in ranges], axis=0)
        return np.sort(least[within])

    def search(self, queries: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places of its ``k`` best with a score of at least ``least``, and their scores; ties go to the smaller id, then row."""
        n, lengths = len(self.ids), _length(queries)
        out: list = [None] * len(queries)
        prefix = []
        for i, (q, length, need) in enumerate(zip(queries, lengths.tolist(), least.tolist(), strict=True)):
            # Shorter candidates can't reach the threshold.
            reach = n if need <= 0 or not length else int(np.searchsorted(-self.length, -(need / length) * (1 - SLACK), "right"))
            found = None
            if reach and need > 0 and (cosine := need / (length * self.length[0])) >= COORDINATE_FROM:
                found = self._in_range(q, length, cosine, reach)
            if found is not None:
                self.looked_up += 1
                out[i] = self._best(found, self.vectors[found] @ q, need, k)
                self.verified += len(found)
            else:
                prefix.append((reach, i))
        # Queries that take like numbers of the longest share a product.
        prefix.sort()
        for a in range(0, len(prefix), 256):
            some = prefix[a : a + 256]
            reach = some[-1][0]
            mine, theirs = queries[[i for _, i in some]], self.vectors[:reach]
            small = reach and lengths[[i for _, i in some]].max() * self.length[0] < SINGLE
            scores = (mine.astype(np.float32) @ theirs.T.astype(np.float32)).astype(np.float64) if small else mine @ theirs.T
            self.verified += scores.size
            for (own, i), s in zip(some, scores, strict=True):
                out[i] = self._best(np.arange(own), s[:own], float(least[i]), k)
        return out

    def _best(self, places: np.ndarray, scores: np.ndarray, need: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(scores) > k:
            need = max(need, np.partition(scores, len(scores) - k)[len(scores) - k])
        keep = scores >= need
        places, scores = places[keep], scores[keep]
        order = np.lexsort((self.rows[places], self.ids[places], -scores))[:k]
        return places[order], scores[order]


def _whole(scores: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(scores), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _scored(found: list, cls: np.ndarray, bucket: Bucket) -> pa.Table:
    of = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
    places = np.concatenate([p for p, _ in found] or [np.empty(0, np.int64)]).astype(np.int64)
    scores = np.concatenate([s for _, s in found] or [np.empty(0)])
    return pa.table({"cls": cls[of], "row": bucket.rows[places], "score": _whole(scores)})


def _seeded(k: int):
    """The first thresholds of queries that come with the longest candidates of their dimension."""

    def work(queries: pa.Table, longest: pa.Table) -> pa.Table:
        n = queries.num_rows
        least = np.zeros(n)
        if n and longest.num_rows >= k:
            bucket = _bucket(longest)
            got = bucket.search(_matrix(queries["vector"]), np.full(n, -np.inf), k)
            least = np.array([s[k - 1] for _, s in got])
        else:
            least[:] = -np.inf
        return pa.table({"cls": queries["cls"], "dim": queries["dim"], "vector": queries["vector"], "least": pa.array(least, pa.float64())})

    return work


def _bucket(t: pa.Table) -> Bucket:
    # Null identifiers come after all others.
    ids = t["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    return Bucket(_matrix(t["vector"]), ids, t["row"].to_numpy())


def _searched(k: int):
    def work(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("cls", "row", "score")})
        bucket = _bucket(candidates)
        found = bucket.search(_matrix(queries["vector"]), queries["least"].to_numpy(), k)
        return _scored(found, queries["cls"].to_numpy(), bucket)

    return work


def _level(length: Column) -> Column:
    """The level of a length; a value just below a border may be put above it, so bounds leave one level of room."""
    return F.when(length > 0, F.floor(F.log2(length) * LEVELS)).otherwise(F.lit(NOWHERE)).cast("int")


def top_products(table: DataFrame, k: int = 5, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` largest inner products of every query row with the other rows: ``query_id``, ``rank`` (from 1), the identifier, ``score`` (long).

    ``is_query`` marks the rows that are queries (all by default); every row but the query's own is a candidate, equal rows and
    rows with the same identifier included. Ties go to the smaller identifier, null after all others, rows that are equal in it in any order. Vectors that
    are null or hold null, NaN or infinite components take no part, nor do empty ones; vectors meet only those with as many
    components. Fewer than ``k`` candidates give fewer rows; an empty table gives none. Components
    should be whole numbers: scores are exact while |query| x |candidate| is below 2^53. Extra columns are ignored.
    """
    ship(table.sparkSession)
    own = Columns(table)
    ident, vector = F.col(own.at(id_col)), F.col(own.at(vector_col)).cast("array<double>")
    asked = F.lit(True) if is_query is None else is_query
    marked = table.withColumn("in_asked", asked).toDF(*own.table.columns, "in_asked")
    good = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = marked.filter(good).select(ident.cast("long").alias("id"), vector.alias("vector"), F.coalesce("in_asked", F.lit(False)).alias("asked"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("vector"), "squares": F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)})
    rows = written(rows.withColumn("length", F.sqrt("squares")).drop("squares"), "search-rows")

    # One more than k, for a query is among the candidates itself.
    most = k + 1
    nth = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last(), "row"))
    candidates = rows.select("id", "row", "vector", "dim", "length").withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")
    candidates = written(candidates.withColumn("level", _level(F.col("length"))), "search-candidates")
    queries = rows.filter("asked").select("id", "row", "vector", "dim", "length")
    classes = queries.groupBy("vector").agg(F.min("row").alias("cls"), F.first("dim").alias("dim"))

    # Candidates of the longest levels, about LONGEST of each dimension: whole levels, and a share of the level where that is reached.
    levels = written(candidates.groupBy("dim", "level").agg(F.count("*").alias("n")), "search-levels")
    longer = F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = levels.withColumn("share", (F.lit(LONGEST) - longer) / F.col("n")).filter("share > 0").drop("n")
    longest = candidates.join(shares, ["dim", "level"]).filter(F.pmod(F.xxhash64(F.lit("longest"), "row"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    classes = written(classes, "search-queries")
    parts = max(1, math.ceil(classes.count() / QUERIES))
    cut = F.pmod(F.xxhash64("cls"), F.lit(parts)).cast("int")
    copies = longest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("dim", "part", "id", "row", "vector")
    seeded = classes.withColumn("part", cut).select("dim", "part", "cls", "vector")
    seeded = seeded.groupBy("dim", "part").cogroup(copies.groupBy("dim", "part")).applyInArrow(_seeded(most), "cls long, dim int, vector array<double>, least double")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    # The level that a candidate needs to reach the threshold; those without one go to all levels.
    needed = F.when((F.col("least") > 0) & (length > 0), _level(F.col("least") / length) - 1).otherwise(F.lit(NOWHERE)).cast("int")
    seeded = written(seeded.withColumn("needed", needed), "search-seeded")

    # Levels of lengths and of thresholds are as many as doubles have, some 17,000 for each dimension, whatever the table.
    parts_of = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    levels = levels.select("dim", "level", parts_of(F.col("n"), CANDIDATES).alias("parts"))
    needs = seeded.groupBy("dim", "needed").agg(parts_of(F.count("*"), QUERIES).alias("blocks"))
    grid = levels.join(needs, "dim").filter(F.col("level") >= F.col("needed"))
    grid = written(grid, "search-grid")
    to = grid.groupBy("dim", "needed", "blocks").agg(F.collect_list(F.struct("level", "parts")).alias("cells"))
    asks = seeded.join(to, ["dim", "needed"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("cell", F.explode("cells"))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cell.parts") - 1))).select("dim", "needed", "block", F.col("cell.level").alias("level"), "part", "cls", "vector", "least")
    back = grid.groupBy("dim", "level", "parts").agg(F.collect_list(F.struct("needed", "blocks")).alias("cells"))
    held = candidates.join(back, ["dim", "level"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("cell", F.explode("cells"))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cell.blocks") - 1))).select("dim", F.col("cell.needed").alias("needed"), "block", "level", "part", "id", "row", "vector")
    cell = ["dim", "needed", "block", "level", "part"]
    scored = asks.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(_searched(most), "cls long, row long, score long")
    named = scored.join(candidates.select("row", "id"), "row")
    best = Window.partitionBy("cls").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    best = named.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= most).select("cls", "row", "id", "score")

    mine = queries.select(F.col("id").alias("query_id"), F.col("row").alias("own"), "vector").join(classes.select("vector", "cls"), "vector").select("query_id", "own", "cls")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row"))
    out = mine.join(best, "cls").filter("own <> row").withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
