"""Scores of retrieval and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(results: DataFrame, k: int = 10, found: str = "found", expected: str = "expected") -> DataFrame:
    """Share of queries whose first ``k`` results hold anything expected."""
    hit = F.arrays_overlap(F.slice(found, 1, k), expected)
    return results.agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("recall"), F.count("*").alias("queries"))


def gate(scores: DataFrame, thresholds: dict[str, float], least: float) -> DataFrame:
    """``pass_rate`` of each metric and whether it reaches ``least``."""
    need = F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("metric"))
    return scores.groupBy("metric").agg(F.avg((F.col("score") >= need).cast("double")).alias("pass_rate")).withColumn("ok", F.col("pass_rate") >= least)


def vram_gb(billions: Column, bytes_each: Column, layers: Column, context: Column, hidden: Column, kv_scale: Column, overhead: float = 1.2) -> Column:
    """Memory of a model's weights and of its cache of keys and values, with an overhead."""
    weights = billions * 1e9 * bytes_each / 2.0**30
    cache = F.lit(2.0) * context * hidden * 2 * layers / 2.0**30 * kv_scale
    return (weights + cache) * overhead
