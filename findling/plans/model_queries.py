"""Queries through the seams for models, with deterministic stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.operators import models
from findling.plans.registry import query
from findling.plans.tables import UUID5, UUID5_DIGEST
from findling.session import table


def _first_words():
    return lambda text: [{"name": w, "type": "WORD", "description": text[:40]} for w in sorted(set(text.split()))[:3]]


@query("e1_embed_texts", "SELECT item_id, 64 AS dimension FROM benchmark")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").withColumnRenamed("text", "content")
    return models.embed_texts(b, models.hash_embedder(64)).select("item_id", F.size("embedding").alias("dimension"))


@query("e3_extract_entities", "SELECT item_id::VARCHAR AS source_chunk_id, unnest(list_slice(list_sort(list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))), 1, 3)) AS name FROM benchmark")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("content"))
    return models.extract_entities(b, _first_words, 1_000_000).select("source_chunk_id", "name")


@query("a13_map_reduce", "SELECT conv_id, sum(length(text))::VARCHAR AS summary FROM conversations GROUP BY conv_id")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("o", F.col("turn") * 10 + F.length("role"))
    count = lambda text: str(sum(int(p) if p.isdigit() else len(p) for p in text.split("\n\n")))
    return models.map_reduce(c, "conv_id", "text", "o", count, 3)


@query("g11_index_document", f"SELECT {UUID5} AS source_id, count(*) AS n FROM (SELECT {UUID5_DIGEST.format("'default:' || lower(lang)")} AS s FROM documents) GROUP BY ALL")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    found = d.select(F.upper("lang").alias("name"), F.lit("LANG").alias("type"), F.lit("").alias("description"), "doc_id")
    relations = d.select(F.col("lang").alias("source_entity"), F.upper("lang").alias("target_entity"), "doc_id")
    known = spark.sql("SELECT 'k' AS id, 'Other' AS name")
    _, linked = models.index_document(found, relations, known, "doc_id", "default")
    return linked.groupBy("source_id").agg(F.count("*").alias("n"))
