"""A session with the settings that the operators are written for."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task of :func:`spread` sorts or aggregates.
SPREAD = 250_000

def local_session(cores: int | None = None, name: str = "findling") -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own settings."""
    n = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the provided tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str):
    """One of the provided tables as a stream of its files, be it one file or a folder: a pattern may name either."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores: a small file, which is one partition, may still be much work for Python."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def spread(rows: DataFrame, many: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in partitions of about SPREAD of the ``many`` there are, so that tasks stay as small however many those are; few are left as they stand."""
    if many <= SPREAD:
        return rows
    return rows.repartition(max(math.ceil(many / SPREAD), rows.sparkSession.sparkContext.defaultParallelism), *keys)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that weren't started with it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_findling_shipped", False):
        return
    home = Path(__file__).resolve().parent
    # The driver serves this file to the executors, so it stays.
    target = Path(tempfile.mkdtemp(prefix="findling-")) / "findling_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent).as_posix())
    sc.addPyFile(str(target))
    sc._findling_shipped = True
