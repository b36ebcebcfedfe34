"""Intermediate tables in the folder that a cluster shares.

A written table cuts lineage like a checkpoint does, but stays columnar and
compressed, so later passes read only the columns they use, and the loss of an
executor never recomputes what stands before it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster that would be a different disk on each machine, so there it is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="findling-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/findling/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._findling_path = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for what an operator keeps itself, deleted with the intermediate tables."""
    path = f"{shared_root(spark)}/findling/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def appended(spark: SparkSession, chunks: Iterable[list[tuple]], schema: str, name: str) -> DataFrame:
    """A table written from the driver part by part, so that only one part is held."""
    path = f"{shared_root(spark)}/findling/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    for chunk in chunks:
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`written` returned and nothing reads any more."""
    for table in tables:
        path = getattr(table, "_findling_path", None)
        if path is not None:
            _delete(table.sparkSession, path)


def tables_now() -> set[str]:
    """Paths of the intermediate tables there are."""
    return set(_WRITTEN)


def discard(spark: SparkSession, paths: set[str]) -> None:
    """Delete intermediate tables by path; those that are gone already don't matter."""
    for path in paths & set(_WRITTEN):
        _delete(spark, path)


def release_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this session; results still unread become invalid."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
