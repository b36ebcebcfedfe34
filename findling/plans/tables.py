"""Tables that queries derive from the provided ones, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.session import spread, table

#: UUID of version 5 in DuckDB SQL: of a digest ``s``, and that of a name.
UUID5 = "(substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12))"
UUID5_DIGEST = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({}))"
LAYER = "CASE label % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'default' WHEN 2 THEN 'layer_hr' ELSE 'layer_engineering' END"
#: A chunk table in DuckDB SQL: windows of 1000 characters that begin every 800.
CHUNKS = """
(SELECT 'd' || doc_id || '-' || i AS id, 'doc-' || doc_id AS document_id, source AS workspace_id,
        CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'default' ELSE 'layer_hr' END AS layer_id,
        CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE 'private' END AS visibility,
        substr(text, (i * 800 + 1)::INT, 1000) AS content, lang, doc_id, i::INT AS chunk_no
 FROM (SELECT *, unnest(range(0, greatest(1, ceil((length(text) - 200) / 800.0)::INT))) AS i FROM documents WHERE length(text) > 0))
"""
#: Vertices and edges of a graph: customers and parts, joined where an order's line joins them.
EDGES = """
(SELECT 'c' || o_custkey AS source_id, 'p' || l_partkey AS target_id, 'BOUGHT' AS type, count(*)::DOUBLE AS weight,
        'e' || o_custkey || '-' || l_partkey AS id
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey)
"""
ENTITIES = """
(SELECT 'c' || c_custkey AS id, c_name AS name, 'CUSTOMER' AS type, CASE c_nationkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'default' ELSE 'layer_hr' END AS layer_id FROM customer
 UNION ALL
 SELECT 'p' || p_partkey, p_name, 'PART', CASE p_size % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'default' ELSE 'layer_hr' END FROM part)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("layer_id", F.expr(LAYER))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findling.operators.text import fixed_windows

    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    out = fixed_windows(docs, 1000, 200)
    layer = F.when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 3 == 1, "default").otherwise("layer_hr")
    return out.select(
        F.concat(F.lit("d"), "doc_id", F.lit("-"), "chunk_no").alias("id"),
        F.concat(F.lit("doc-"), "doc_id").alias("document_id"),
        F.col("source").alias("workspace_id"),
        layer.alias("layer_id"),
        F.when(F.col("doc_id") % 2 == 0, "public").otherwise("private").alias("visibility"),
        "content",
        "lang",
        "doc_id",
        "chunk_no",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    many = li.count()
    bought = spread(o, many, "o_orderkey").join(spread(li, many, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = spread(bought, many, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    return pairs.select(
        F.concat(F.lit("c"), "o_custkey").alias("source_id"),
        F.concat(F.lit("p"), "l_partkey").alias("target_id"),
        F.lit("BOUGHT").alias("type"),
        "weight",
        F.concat(F.lit("e"), "o_custkey", F.lit("-"), "l_partkey").alias("id"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = lambda c: F.when(c % 3 == 0, "public").when(c % 3 == 1, "default").otherwise("layer_hr")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("CUSTOMER").alias("type"), layer(F.col("c_nationkey")).alias("layer_id"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("PART").alias("type"), layer(F.col("p_size")).alias("layer_id"))
    return c.unionByName(p)
