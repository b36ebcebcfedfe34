"""Queries over vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.functions import vectors as V
from findling.operators import memory, vector as op
from findling.operators.vector_index import VectorIndex
from findling.plans.registry import ORACLES, query
from findling.plans.tables import LAYER, query_vector, vectors
from findling.session import table
from findling.storage import folder

_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_COS = "list_cosine_similarity(embedding::DOUBLE[], q)"
_L2 = "sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
R = lambda c: F.round(c, 6)


@query("k1_l2_topk", f"SELECT vec_id, round(1 - {_L2}, 6) AS score FROM embeddings, {_Q} WHERE {LAYER} IN ('default', 'public') ORDER BY {_L2}, vec_id LIMIT 10")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return op.top_k(vectors(spark, sf), query_vector(spark, sf), 10, "l2").select("vec_id", R("score").alias("score"))


@query("k2_cosine_topk", f"SELECT vec_id, layer_id, round(s, 6) AS score FROM (SELECT vec_id, {LAYER} AS layer_id, {_COS} AS s FROM embeddings, {_Q} WHERE vec_id <> 0) WHERE layer_id IN ('default', 'public', 'layer_hr') ORDER BY s DESC, vec_id LIMIT 10")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    others = vectors(spark, sf).filter("vec_id <> 0")
    found = op.top_k(others, query_vector(spark, sf), 10, "cosine", ["default", "public", "layer_hr"])
    return found.select("vec_id", "layer_id", R("score").alias("score"))


def _index(spark: SparkSession, rows: DataFrame, metric: str) -> VectorIndex:
    index = VectorIndex(spark, folder(spark, "index"), metric)
    index.build(rows)
    return index


@query("k1_indexed_topk", ORACLES["k1_l2_topk"])
def k1_indexed(spark: SparkSession, sf: str) -> DataFrame:
    found = _index(spark, vectors(spark, sf), "l2").search(query_vector(spark, sf), 10)
    return found.select("vec_id", R("score").alias("score"))


@query("k2_indexed_topk", ORACLES["k2_cosine_topk"])
def k2_indexed(spark: SparkSession, sf: str) -> DataFrame:
    found = _index(spark, vectors(spark, sf).filter("vec_id <> 0"), "cosine").search(query_vector(spark, sf), 10, ["default", "public", "layer_hr"])
    return found.select("vec_id", "layer_id", R("score").alias("score"))


@query("k2_threshold_search", f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_COS} AS s FROM embeddings, {_Q} WHERE {LAYER} IN ('default', 'public') ORDER BY s DESC, vec_id LIMIT 4) WHERE s >= 0.25")
def k2_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return op.threshold_search(vectors(spark, sf), query_vector(spark, sf)).select("vec_id", R("score").alias("score"))


@query("k3_similarity_compat", f"SELECT vec_id, round(CASE WHEN d >= 1 THEN 1.0 WHEN d < 0 THEN 1 - abs(d) ELSE 1 - d END, 6) AS compat, round(1 - d, 6) AS strict FROM (SELECT vec_id, round(1 - {_COS}, 9) AS d FROM embeddings, {_Q})")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    d = F.round(V.distance("cosine", F.col("embedding"), F.lit(query_vector(spark, sf))), 9)
    return vectors(spark, sf).select("vec_id", R(V.similarity(d, strict=False)).alias("compat"), R(V.similarity(d)).alias("strict"))


@query("k4_rerank_width", "SELECT label, count(*) AS n, greatest(10, least(50, ceil(0.1 * count(*))))::INT AS width FROM embeddings GROUP BY label")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n")).withColumn("width", V.rerank_width(F.col("n")))


@query("k5_rerank_sigmoid", f"SELECT vec_id, round(1 / (1 + exp(-logit)), 6) AS rerank_score FROM (SELECT vec_id, 4 * round({_COS}, 9) - label / 5.0 AS logit FROM embeddings, {_Q}) ORDER BY 1 / (1 + exp(-logit)) DESC, vec_id LIMIT 20")
def k5(spark: SparkSession, sf: str) -> DataFrame:
    c = F.round(V.cosine(F.col("embedding"), F.lit(query_vector(spark, sf))), 9)
    rows = vectors(spark, sf).select("vec_id", c.alias("score"), (4 * c - F.col("label") / 5.0).alias("logit"))
    return op.rerank(rows, 20, "logit", id_col="vec_id").select("vec_id", R("rerank_score").alias("rerank_score"))


@query("k6_rerank_passthrough", f"SELECT vec_id, round({_COS}, 6) AS rerank_score FROM embeddings, {_Q} ORDER BY {_COS} DESC, vec_id LIMIT 5")
def k6(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).withColumn("score", V.cosine(F.col("embedding"), F.lit(query_vector(spark, sf))))
    return op.rerank(rows, 5, id_col="vec_id").select("vec_id", R("rerank_score").alias("rerank_score"))


_RRF = f"""
WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) - 1 AS r FROM embeddings, {_Q} WHERE {LAYER} IN ('default', 'public') QUALIFY r < 20),
g AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label, vec_id) - 1 AS r FROM embeddings QUALIFY r < 20)
SELECT id, round(sum(1.0 / (60 + r + 1)), 9) AS rrf, min(src)::INT AS source
FROM (SELECT id, r, 0 AS src FROM v UNION ALL SELECT id, r, 1 FROM g) GROUP BY id
"""


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    found = op.top_k(vectors(spark, sf), query_vector(spark, sf), 20).withColumnRenamed("vec_id", "id")
    graph = vectors(spark, sf).orderBy("label", "vec_id").limit(20).withColumnRenamed("vec_id", "id")
    return op.reciprocal_rank_fusion([(found, F.col("score").desc()), (graph, F.col("label").asc())])


@query("k7_reciprocal_rank_fusion", _RRF)
def k7(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("id", F.round("rrf", 9).alias("rrf"), "source")


@query("k8_balanced_search", f"SELECT id, rrf FROM ({_RRF}) ORDER BY rrf DESC, id LIMIT 10")
def k8(spark: SparkSession, sf: str) -> DataFrame:
    fused = _fused(spark, sf).select("id", F.round("rrf", 9).alias("rrf"))
    return op.rerank(fused, 10, fallback_col="rrf").select("id", "rrf")


@query("p1_layer_prefilter", f"SELECT vec_id, {LAYER} AS layer_id FROM embeddings WHERE {LAYER} IN ('default', 'public')")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return op.prefilter(vectors(spark, sf)).select("vec_id", "layer_id")


@query("p13_pinned_after_limit", f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_COS} AS s FROM embeddings, {_Q} WHERE {LAYER} IN ('default', 'public') ORDER BY s DESC, vec_id LIMIT 12) WHERE s >= 0.1 AND vec_id % 2 = 0")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    pinned = table(spark, sf, "embeddings").filter("vec_id % 2 = 1").select("vec_id")
    return op.threshold_search(vectors(spark, sf), query_vector(spark, sf), 12, 0.1, pinned).select("vec_id", R("score").alias("score"))


# A rounded zero has no sign, a zero vector stays, and one with a null component has no length.
@query("m1_l2_normalise", "SELECT vec_id, list_transform(v, lambda x: round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) + 0::DOUBLE) AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_reduce(list_transform(embedding::DOUBLE[], lambda x: x * x), lambda a, x: a + x, 0::DOUBLE)) AS n FROM embeddings)")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform(V.normalise(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("m2_similarity_matrix", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return op.similarity_matrix(e, e.filter("vec_id % 50 = 0"), "vec_id").select("a", "b", R("dot").alias("dot"))


# A rounded zero has no sign, and no vector has no mean.
@query("m3_mean_pool", "SELECT vec_id, CASE WHEN embedding IS NOT NULL THEN list_transform(range(1, 1 + least(32, len(embedding))), lambda i: round((embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2, 6) + 0::DOUBLE) END AS pooled FROM embeddings")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    halves = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), F.slice("embedding", 1, 32))
    pooled = V.mean_pool(halves, F.array(F.lit(1), F.lit(1), F.lit(0)))
    return table(spark, sf, "embeddings").select("vec_id", F.transform(pooled, lambda x: F.round(x, 6)).alias("pooled"))


@query("m4_sigmoid", "SELECT vec_id, round(1 / (1 + exp(-(embedding[1]::DOUBLE * 10))), 6) AS p FROM embeddings")
def m4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", R(V.sigmoid(F.get("embedding", F.lit(0)).cast("double") * 10)).alias("p"))


#: Copies are linked with the first row of their vector, other vectors in pairs of first rows.
SIMILAR = """
WITH r AS (SELECT 't' || label AS type, vec_id, embedding::DOUBLE[] AS v, min(vec_id) OVER (PARTITION BY label, embedding) AS rep FROM embeddings)
SELECT a.type, a.vec_id AS source_id, b.vec_id AS target_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
FROM r a JOIN r b ON a.type = b.type AND a.vec_id > b.vec_id AND a.vec_id = a.rep AND b.vec_id = b.rep
WHERE list_cosine_similarity(a.v, b.v) >= 0.37
UNION ALL SELECT type, vec_id, rep, 1.0 FROM r WHERE vec_id <> rep
"""


@query("j10_similarity_join", SIMILAR)
def j10(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").withColumn("type", F.concat(F.lit("t"), "label"))
    pairs = op.similarity_join(rows, 0.37, "type", "vec_id")
    return pairs.select("type", "source_id", "target_id", R("similarity").alias("similarity"))


@query("j11_nearest_names", f"SELECT 'entity ' || vec_id AS name, round({_COS}, 6) AS similarity FROM embeddings, {_Q} WHERE vec_id <> 0 ORDER BY {_COS} DESC, vec_id LIMIT 5")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).filter("vec_id <> 0").withColumn("layer_id", F.lit("public"))
    found = op.top_k(rows, query_vector(spark, sf), 5)
    return found.select(F.concat(F.lit("entity "), "vec_id").alias("name"), R("score").alias("similarity"))


@query("j12_federated_search", f"SELECT vec_id, origin, round(s, 6) AS score FROM (SELECT vec_id, CASE WHEN label < 5 THEN 'workspace' ELSE 'global' END AS origin, {_COS} AS s FROM embeddings, {_Q} WHERE {LAYER} IN ('default', 'public')) ORDER BY s DESC, vec_id LIMIT 10")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    parts = [v.filter("label < 5").withColumn("origin", F.lit("workspace")), v.filter("label >= 5").withColumn("origin", F.lit("global"))]
    return op.federated_search(parts, query_vector(spark, sf), 10).select("vec_id", "origin", R("score").alias("score"))


@query("e5_utterance_router", "WITH u AS (SELECT vec_id AS u, label AS route, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 10) SELECT vec_id, CASE WHEN max(round(list_cosine_similarity(embedding::DOUBLE[], q), 9)) >= 0.3 THEN arg_max(route, (round(list_cosine_similarity(embedding::DOUBLE[], q), 9), -u)) ELSE -1 END::INT AS route FROM embeddings, u GROUP BY vec_id")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    # The utterances are a stated, small set.
    known = table(spark, sf, "embeddings").filter("vec_id < 10").select("vec_id", "label", "embedding").collect()
    votes = F.array(*[F.struct(F.round(V.cosine(F.col("embedding"), F.lit(r["embedding"])), 9).alias("s"), F.lit(-r["vec_id"]).alias("o"), F.lit(r["label"]).alias("route")) for r in known])
    best = F.array_max(votes)
    return table(spark, sf, "embeddings").select("vec_id", F.when(best["s"] >= 0.3, best["route"]).otherwise(-1).cast("int").alias("route"))


@query("e8_memory_search", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings, {_Q} WHERE label = 3 ORDER BY {_COS} DESC, vec_id LIMIT 5")
def e8(spark: SparkSession, sf: str) -> DataFrame:
    own = vectors(spark, sf).filter("label = 3").withColumn("layer_id", F.lit("default"))
    return op.top_k(own, query_vector(spark, sf), 5).select("vec_id", R("score").alias("score"))


#: Turns of conversations, described by how often each letter stands in them: answers are remembered, what users say are facts.
_TURNS = """(SELECT conv_id // 20 AS user_id, conv_id * 10000 + coalesce(turn, -1) AS id, role, text, coalesce(turn, -1) >= 4 AS forget,
 list_transform(range(97, 123), lambda c: (length(text) - length(replace(text, chr(c::INT), '')))::DOUBLE) AS v FROM conversations)"""
_NEAR = 0.97
DECISIONS = f"""
WITH t AS {_TURNS}, held AS (SELECT * FROM t WHERE role <> 'user'), fact AS (SELECT * FROM t WHERE role = 'user'),
p AS (SELECT f.id AS fact_id, h.id AS memory_id, h.text AS known, round(list_cosine_similarity(f.v, h.v), 9) AS s FROM fact f JOIN held h ON f.user_id = h.user_id
 WHERE list_dot_product(f.v, f.v) > 0 AND list_dot_product(h.v, h.v) > 0),
b AS (SELECT * FROM p WHERE s >= {_NEAR} QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY s DESC, memory_id) = 1),
a AS (SELECT user_id, id AS fact_id, text, memory_id, s, CASE WHEN memory_id IS NOT NULL AND forget THEN 'DELETE' WHEN forget OR known = text THEN 'NONE' WHEN memory_id IS NOT NULL THEN 'UPDATE' ELSE 'ADD' END AS act FROM fact LEFT JOIN b ON fact_id = id),
d AS (SELECT user_id, fact_id, memory_id, text, s, CASE WHEN act IN ('DELETE', 'UPDATE') AND fact_id < max(fact_id) FILTER (act IN ('DELETE', 'UPDATE')) OVER (PARTITION BY memory_id) THEN 'NONE'
 WHEN act = 'ADD' AND fact_id > min(fact_id) FILTER (act = 'ADD') OVER (PARTITION BY user_id, text) THEN 'NONE' ELSE act END AS action FROM a)
"""


def _turns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turn, text = F.coalesce("turn", F.lit(-1)), F.col("text")
    letters = F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(chr(c)), F.lit("")))).cast("double") for c in range(97, 123)])
    rows = table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 20).alias("user_id"), (F.col("conv_id") * 10_000 + turn).alias("id"), "role", text.alias("content"), letters.alias("embedding"), (turn >= 4).alias("forget"))
    return rows.filter("role <> 'user'").withColumnRenamed("id", "memory_id").drop("role", "forget"), rows.filter("role = 'user'").withColumnRenamed("id", "fact_id").drop("role")


@query("e8_memory_decisions", DECISIONS + "SELECT user_id, fact_id, memory_id, round(s, 6) AS similarity, action FROM d")
def e8_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return memory.decide(*_turns(spark, sf), _NEAR).select("user_id", "fact_id", "memory_id", R("similarity").alias("similarity"), "action")


@query("e8_memory_after", DECISIONS + """SELECT user_id, id AS memory_id, coalesce(c.text, h.text) AS content FROM held h LEFT JOIN (SELECT memory_id, text, action FROM d WHERE action IN ('UPDATE', 'DELETE')) c ON c.memory_id = h.id
WHERE action IS DISTINCT FROM 'DELETE' UNION ALL SELECT user_id, fact_id, text FROM d WHERE action = 'ADD'""")
def e8_after(spark: SparkSession, sf: str) -> DataFrame:
    return memory.remember(*_turns(spark, sf), _NEAR).select("user_id", "memory_id", "content")
