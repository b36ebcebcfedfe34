"""Queries over relational tables: access, listings, counts, joins, budgets, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findling.operators import access, governance, jobs, tables as op
from findling.operators import text as txt
from findling.plans.registry import query
from findling.plans.tables import CHUNKS, UUID5, UUID5_DIGEST, chunks
from findling.session import table

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
now = lambda: F.to_timestamp(F.lit("2024-01-31 00:00:00"))
T = table

# ---- access tables from the given ones: a layer for each nation, a user for each customer; the same in SQL and in Spark
LAYERS = """(SELECT 'n' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'SYSTEM' ELSE 'TEAM' END AS type, n_nationkey % 7 = 3 AS is_soft_deleted,
 15000 * n_regionkey AS storage_quota_bytes, coalesce(used, 0)::BIGINT AS storage_used_bytes
 FROM nation LEFT JOIN (SELECT s_nationkey AS k, sum(l_quantity) AS used FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey) ON k = n_nationkey)"""
GRANTS = """(SELECT 'n' || n_nationkey AS layer_id, 'nation-' || n_nationkey AS role_pattern, 'WRITE' AS access_level FROM nation
 UNION ALL SELECT 'n' || n_nationkey, '*', 'READ' FROM nation WHERE n_nationkey % 10 = 0
 UNION ALL SELECT 'n' || n_nationkey, 'nation-' || n_regionkey || '*', 'READ' FROM nation WHERE n_nationkey % 4 = 1
 UNION ALL SELECT 'n' || n_nationkey, 'nation-_' || n_regionkey, 'ADMIN' FROM nation WHERE n_nationkey % 6 = 2
 UNION ALL SELECT DISTINCT 'n' || s_nationkey, 'user:' || o_custkey, CASE WHEN o_custkey % 4 = 0 THEN 'ADMIN' ELSE 'READ' END
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""
ROLES = "(SELECT c_custkey AS user_id, 'nation-' || c_nationkey AS role FROM customer UNION ALL SELECT c_custkey, 'user:' || c_custkey FROM customer)"
named = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    """A layer for each nation; what its suppliers sold is its storage."""
    sold = T(spark, sf, "lineitem").join(T(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("l_quantity").alias("used"))
    nation = T(spark, sf, "nation").join(sold, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    kind = F.when(F.col("n_nationkey") % 5 == 0, "SYSTEM").otherwise("TEAM").alias("type")
    used = F.coalesce(F.col("used").cast("long"), F.lit(0)).alias("storage_used_bytes")
    return nation.select(named("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), kind, (F.col("n_nationkey") % 7 == 3).alias("is_soft_deleted"), (F.col("n_regionkey") * 15_000).alias("storage_quota_bytes"), used)


def _grants(spark: SparkSession, sf: str) -> DataFrame:
    """Nations write to their layers, patterns reach several nations, customers read where they bought."""
    n = T(spark, sf, "nation")
    layer, level = named("n", "n_nationkey").alias("layer_id"), lambda name: F.lit(name).alias("access_level")
    pattern = lambda c: c.alias("role_pattern")
    kinds = [
        n.select(layer, pattern(named("nation-", "n_nationkey")), level("WRITE")),
        n.filter("n_nationkey % 10 = 0").select(layer, pattern(F.lit("*")), level("READ")),
        n.filter("n_nationkey % 4 = 1").select(layer, pattern(F.concat(named("nation-", "n_regionkey"), F.lit("*"))), level("READ")),
        n.filter("n_nationkey % 6 = 2").select(layer, pattern(named("nation-_", "n_regionkey")), level("ADMIN")),
    ]
    bought = T(spark, sf, "lineitem").join(T(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = bought.select("s_nationkey", "o_custkey").distinct()
    kinds.append(bought.select(named("n", "s_nationkey").alias("layer_id"), pattern(named("user:", "o_custkey")), F.when(F.col("o_custkey") % 4 == 0, "ADMIN").otherwise("READ").alias("access_level")))
    return reduce(DataFrame.unionByName, kinds)


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer has the role of its nation and one of its own."""
    roles = F.array(named("nation-", "c_nationkey"), named("user:", "c_custkey"))
    return T(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(roles).alias("role"))


@query(
    "p2_token_layers",
    "SELECT user_id, list_sort(list_distinct(['default', 'public', 'u' || user_id] || CASE WHEN user_id % 3 = 0 THEN ['layer_engineering'] ELSE [] END || CASE WHEN user_id % 5 = 0 THEN ['restricted', 'admin'] ELSE [] END)) AS layers FROM (SELECT DISTINCT user_id FROM events)",
)
def p2(spark: SparkSession, sf: str) -> DataFrame:
    roles = F.concat(F.when(F.col("user_id") % 3 == 0, F.array(F.lit("group:engineering"))).otherwise(F.array().cast("array<string>")), F.when(F.col("user_id") % 5 == 0, F.array(F.lit("admin"))).otherwise(F.array().cast("array<string>")))
    users = T(spark, sf, "events").select("user_id").distinct()
    return users.select("user_id", F.array_sort(access.token_layers(F.concat(F.lit("u"), "user_id"), roles)).alias("layers"))


_PUBLIC = f"SELECT l.id FROM {LAYERS} l WHERE type = 'SYSTEM' AND NOT is_soft_deleted AND EXISTS (SELECT 1 FROM {GRANTS} g WHERE g.layer_id = l.id AND g.role_pattern IN ('*', '%'))"


def _resolved(only: str = "") -> str:
    """A pattern without wildcard is like itself only, so the two kinds are joined apart."""
    live = f"SELECT layer_id, role_pattern FROM {GRANTS} g JOIN {LAYERS} l ON l.id = g.layer_id WHERE NOT l.is_soft_deleted {only}"
    wild = "(contains(role_pattern, '*') OR contains(role_pattern, '%') OR contains(role_pattern, '_'))"
    return f"""WITH g AS ({live}), r AS {ROLES} SELECT DISTINCT user_id, layer_id FROM (SELECT user_id, layer_id FROM r JOIN g ON role = role_pattern
 UNION ALL SELECT user_id, layer_id FROM r JOIN (SELECT DISTINCT * FROM g WHERE {wild}) w ON role LIKE replace(role_pattern, '*', '%') UNION ALL SELECT user_id, p.id FROM r, ({_PUBLIC}) p)"""


@query("p3_resolve_layers", _resolved())
def p3(spark: SparkSession, sf: str) -> DataFrame:
    return access.resolve_layers(_roles(spark, sf), _layers(spark, sf), _grants(spark, sf))


@query("p3_resolve_writable", _resolved("AND access_level IN ('WRITE', 'ADMIN')"))
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return access.resolve_layers(_roles(spark, sf), _layers(spark, sf), _grants(spark, sf), level="WRITE")


@query("p4_public_layers", f"SELECT id, name FROM {LAYERS} WHERE id IN ({_PUBLIC})")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return access.public_layers(_layers(spark, sf), _grants(spark, sf))


@query("p6_may_write", f"SELECT c_custkey AS user_id, EXISTS (SELECT 1 FROM {GRANTS} g WHERE layer_id = 'n3' AND access_level IN ('WRITE', 'ADMIN') AND role_pattern IN ('*', '%', 'user:' || c_custkey)) AS allowed FROM customer")
def p6(spark: SparkSession, sf: str) -> DataFrame:
    return access.may_write(T(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), _grants(spark, sf), "n3")


@query("p7_quota", f"SELECT id, greatest(0, storage_used_bytes - 120)::BIGINT AS used_after, greatest(0, storage_used_bytes - 120) >= storage_quota_bytes AS exceeded FROM {LAYERS}")
def p7(spark: SparkSession, sf: str) -> DataFrame:
    return access.quota(_layers(spark, sf), F.lit(-120)).select("id", F.col("used_after").cast("long").alias("used_after"), "exceeded")


@query("p8_retention_delete", f"SELECT event_id FROM events WHERE event_type = 'error' AND ts <= {AS_OF} - INTERVAL 15 DAY")
def p8(spark: SparkSession, sf: str) -> DataFrame:
    return governance.expired(T(spark, sf, "events").filter("event_type = 'error'"), "ts", 15, now()).select("event_id")


@query("c4_chat_retention", f"SELECT event_id FROM events WHERE ts > {AS_OF} - INTERVAL 10 DAY")
def c4(spark: SparkSession, sf: str) -> DataFrame:
    return governance.retained(T(spark, sf, "events"), "ts", 10, now()).select("event_id")


@query("c5_memory_window", f"SELECT user_id, count(*) AS n FROM events WHERE ts > {AS_OF} - INTERVAL 20 DAY AND event_type <> 'view' GROUP BY user_id")
def c5(spark: SparkSession, sf: str) -> DataFrame:
    return governance.retained(T(spark, sf, "events"), "ts", 20, now()).filter("event_type <> 'view'").groupBy("user_id").agg(F.count("*").alias("n"))


@query("c6_bulk_delete", "SELECT event_id, CASE WHEN event_id IS NOT NULL THEN 'deleted' END AS status FROM events WHERE event_id % 7 = 0 UNION ALL SELECT -1, 'not found'")
def c6(spark: SparkSession, sf: str) -> DataFrame:
    e = T(spark, sf, "events")
    asked = e.filter("event_id % 7 = 0").select("event_id").unionByName(spark.sql("SELECT -1L AS event_id"))
    found = e.select(F.col("event_id").alias("x"))
    return asked.join(found, F.col("event_id") == F.col("x"), "left").select("event_id", F.when(F.col("x").isNull(), "not found").otherwise("deleted").alias("status"))


@query("p9_audit_page", "SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    rows = op.dynamic_filter(T(spark, sf, "events"), event_type="click", user_id=None)
    return op.page(rows, [F.col("ts").desc(), F.col("event_id").desc()], 40, 20).select("event_id", "ts")


@query("p10_stale_queue", f"SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 7 DAY <= {AS_OF}")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    due = T(spark, sf, "orders").filter("o_orderstatus = 'O'").filter(F.expr("o_orderdate + INTERVAL 7 DAYS") <= now())
    c, n = T(spark, sf, "customer"), T(spark, sf, "nation")
    return due.join(c, due["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query("p11_watchable", "SELECT page_id, starts_with(url, 'https://') OR starts_with(url, 'link://') AS watchable FROM pages")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "pages").select("page_id", (F.startswith("url", F.lit("https://")) | F.startswith("url", F.lit("link://"))).alias("watchable"))


@query("p12_null_filters", "SELECT conv_id, turn FROM conversations WHERE nullif(role, 'system') IS NOT NULL AND nullif(turn, 0) IS NULL")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "conversations").filter(F.nullif("role", F.lit("system")).isNotNull() & F.nullif("turn", F.lit(0)).isNull()).select("conv_id", "turn")


@query("p14_dry_run", "SELECT 'delete' AS operation, count(*) AS affected_count, count(*) > 0 AS can_proceed FROM events WHERE event_type = 'error'")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "events").filter("event_type = 'error'").agg(F.lit("delete").alias("operation"), F.count("*").alias("affected_count"), (F.count("*") > 0).alias("can_proceed"))


@query("p16_invalidate_history", "SELECT conv_id, turn, NOT (conv_id % 2 = 0) AS include FROM conversations")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "conversations").withColumn("include", F.when(F.col("conv_id") % 2 == 0, False).otherwise(True)).select("conv_id", "turn", "include")


# ---- chunk table
@query("s4_point_get", f"SELECT id, content FROM {CHUNKS} WHERE id = 'd3-0'")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return op.point_get(c.filter("workspace_id = 'src0'"), c, "id", "d3-0").select("id", "content")


@query("s5_paged_listing", f"SELECT id FROM {CHUNKS} WHERE layer_id = 'public' ORDER BY id LIMIT 25 OFFSET 50")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return op.page(chunks(spark, sf).filter("layer_id = 'public'"), ["id"], 50, 25).select("id")


@query("s6_page_has_more", f"SELECT id, true AS has_more FROM {CHUNKS} ORDER BY id LIMIT 10 OFFSET 20")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    return op.page_with_more(chunks(spark, sf).select("id"), ["id"], 3, 10)


@query("s12_migrate_schema", f"SELECT id, content, coalesce(NULL, 'default') AS layer_id, 'private' AS visibility, 'v2' AS version FROM {CHUNKS}")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    from findling.sources.store import migrate_v1

    return migrate_v1(chunks(spark, sf).select("id", "content")).select("id", "content", "layer_id", "visibility", "version")


@query("s30_sql", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def s30(spark: SparkSession, sf: str) -> DataFrame:
    from findling.sources.sql import run_sql

    return run_sql(spark, sf, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")


_REVENUE = "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"


@query("s30_sql_join", _REVENUE)
def s30_join(spark: SparkSession, sf: str) -> DataFrame:
    from findling.sources.sql import run_sql

    return run_sql(spark, sf, _REVENUE)


@query("s30_table_schema", "SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type FROM (DESCRIBE customer)")
def s30_schema(spark: SparkSession, sf: str) -> DataFrame:
    from findling.sources.sql import table_schema

    return table_schema(spark, sf, "customer")


@query("s34_transcript_rows", "SELECT conv_id, turn, list_transform(range(0, 8), lambda i: 0.0::FLOAT) AS embedding FROM conversations")
def s34(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "conversations").select("conv_id", "turn", F.array_repeat(F.lit(0.0).cast("float"), 8).alias("embedding"))


@query("s33_vector_cache", "SELECT page_id, sha256(url) AS key FROM pages WHERE page_id % 2 = 1")
def s33(spark: SparkSession, sf: str) -> DataFrame:
    keyed = T(spark, sf, "pages").select("page_id", F.sha2("url", 256).alias("key"))
    cached = T(spark, sf, "pages").filter("page_id % 2 = 0").select(F.sha2("url", 256).alias("k"), F.col("page_id").alias("i"))
    return keyed.join(cached, (F.col("key") == F.col("k")) & (F.col("page_id") == F.col("i")), "left_anti")


# ---- joins
@query("j1_layer_permissions", f"SELECT workspace_id, l.name, g.role_pattern, g.access_level FROM {LAYERS} l JOIN {GRANTS} g ON g.layer_id = l.id JOIN (SELECT DISTINCT c_mktsegment AS workspace_id, 'n' || c_nationkey AS layer_id FROM customer WHERE c_acctbal > 9000) m ON m.layer_id = l.id")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    mapping = T(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_mktsegment").alias("workspace_id"), named("n", "c_nationkey").alias("layer_id")).distinct()
    return access.layer_permissions(_layers(spark, sf), _grants(spark, sf), mapping)


@query("j2_workspace_layers", "SELECT c_mktsegment AS workspace, n_name AS layer, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    c, n = T(spark, sf, "customer"), T(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy(F.col("c_mktsegment").alias("workspace"), F.col("n_name").alias("layer")).agg(F.count("*").alias("members"))


@query("j3_chat_defaults", "SELECT event_id, coalesce(c_name, 'deleted workspace') AS workspace, CASE WHEN user_id % 10 = 0 THEN 'API' ELSE coalesce(s_name, 'unknown user') END AS username FROM events LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0 LEFT JOIN supplier ON s_suppkey = user_id")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    e, c, s = T(spark, sf, "events"), T(spark, sf, "customer").filter("c_acctbal > 0"), T(spark, sf, "supplier")
    j = e.join(c, e["user_id"] == c["c_custkey"], "left").join(s, e["user_id"] == s["s_suppkey"], "left")
    return j.select("event_id", F.coalesce("c_name", F.lit("deleted workspace")).alias("workspace"), F.when(F.col("user_id") % 10 == 0, "API").otherwise(F.coalesce("s_name", F.lit("unknown user"))).alias("username"))


@query("j4_include_counts", "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    n = T(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = T(spark, sf, "customer")
    return c.join(n, c["c_custkey"] == n["o_custkey"], "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("j9_speaker_overlap", "WITH s AS (SELECT conv_id, turn AS seg_id, turn * 10.0 AS a, turn * 10.0 + 12 AS b FROM conversations), t AS (SELECT conv_id, turn, role AS speaker, turn * 11.0 AS ts, turn * 11.0 + 9 AS te FROM conversations) SELECT s.conv_id, s.seg_id, coalesce((SELECT speaker FROM t WHERE t.conv_id = s.conv_id AND least(b, te) > greatest(a, ts) ORDER BY least(b, te) - greatest(a, ts) DESC, ts LIMIT 1), 'Unknown') AS speaker FROM s")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    c = T(spark, sf, "conversations")
    s = c.select("conv_id", F.col("turn").alias("seg_id"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 12).alias("end"))
    t = c.select("conv_id", (F.col("turn") * 11.0).alias("start"), (F.col("turn") * 11.0 + 9).alias("end"), F.col("role").alias("speaker"))
    return op.interval_speakers(s, t, "conv_id").select("conv_id", "seg_id", "speaker")


@query("j13_orphans", "SELECT c_mktsegment AS collection, count(*) AS n, true AS has_layer FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment UNION ALL SELECT c_mktsegment, count(*), false FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_mktsegment")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    n = T(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("collection")).agg(F.count("*").alias("n"))
    layers = T(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("collection")).distinct()
    known = n.join(layers, "collection", "left_semi").withColumn("has_layer", F.lit(True))
    return known.unionByName(n.join(layers, "collection", "left_anti").withColumn("has_layer", F.lit(False)))


@query("j15_orphan_files", r"SELECT page_id FROM pages WHERE page_id % 3 = 0")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    slug = lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", "-"))
    p = T(spark, sf, "pages")
    files = p.select("page_id", slug(F.concat("url", F.lit(" "), "page_id")).alias("name"))
    known = p.filter("page_id % 3 <> 0").select(slug(F.upper(F.concat("url", F.lit("_"), "page_id"))).alias("name"))
    return files.join(known, "name", "left_anti").select("page_id")


# ---- aggregates
@query("a1_collection_counts", f"SELECT workspace_id, count(*) AS n, sum(length(content))::BIGINT AS chars FROM {CHUNKS} GROUP BY workspace_id")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).groupBy("workspace_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("a2_layer_distribution", f"SELECT layer_id, count(*) AS n FROM {CHUNKS} GROUP BY layer_id")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).groupBy("layer_id").agg(F.count("*").alias("n"))


@query("a3_document_list", f"SELECT document_id, count(*) AS n, arg_min(substr(content, 1, 20), chunk_no) AS title FROM {CHUNKS} GROUP BY document_id")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).groupBy("document_id").agg(F.count("*").alias("n"), F.min_by(F.substring("content", 1, 20), "chunk_no").alias("title"))


@query("a5_token_sum", "SELECT source, coalesce(sum(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars // 4 END), 0)::BIGINT AS tokens FROM documents GROUP BY source")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 != 0, F.floor(F.col("n_chars") / 4))
    return T(spark, sf, "documents").groupBy("source").agg(F.coalesce(F.sum(t), F.lit(0)).alias("tokens"))


@query("a6_active_users", f"SELECT DISTINCT user_id FROM events WHERE ts >= {AS_OF} - INTERVAL 3 DAY")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "events").filter(F.col("ts") >= now() - F.expr("INTERVAL 3 DAYS")).select("user_id").distinct()


_DAY = "ts > TIMESTAMP '2024-01-14 15:30:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-14 15:30:00'"
_then = lambda: F.to_timestamp(F.lit("2024-01-14 15:30:00"))


@query("a7_daily_limit", f"SELECT user_id, count(*) FILTER (WHERE {_DAY}) AS sent, user_id % 10 = 0 OR count(*) FILTER (WHERE {_DAY}) < 3 AS may_send FROM events GROUP BY user_id")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    n = jobs.sent_within(T(spark, sf, "events"), ["user_id"], "ts", _then())
    return n.withColumn("may_send", (F.col("user_id") % 10 == 0) | (F.col("sent") < 3))


@query("a14_recall_at_k", "SELECT round(avg(hit), 6) AS recall FROM (SELECT item_id, CASE WHEN item_id % 4 = 0 OR length(text) > 200 THEN 1.0 ELSE 0.0 END AS hit FROM benchmark)")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    from findling.operators.evaluation import recall_at_k

    b = T(spark, sf, "benchmark").select("item_id", F.array(F.when((F.col("item_id") % 4 == 0) | (F.length("text") > 200), "hit").otherwise("x")).alias("found"), F.array(F.lit("hit")).alias("expected"))
    return recall_at_k(b).select(F.round("recall", 6).alias("recall"))


@query("a15_quality_gate", "SELECT metric, round(avg(passed::INT), 6) AS pass_rate, avg(passed::INT) >= 0.5 AS ok FROM (SELECT 'quality' AS metric, quality >= 1 AS passed FROM labels UNION ALL SELECT 'clean', toxic < 1 FROM labels) GROUP BY metric")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    from findling.operators.evaluation import gate

    s = T(spark, sf, "labels")
    s = s.select(F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("score")).unionByName(s.select(F.lit("clean"), (1 - F.col("toxic")).cast("double")).toDF("metric", "score"))
    return gate(s, {"quality": 1.0, "clean": 1.0}, 0.5).select("metric", F.round("pass_rate", 6).alias("pass_rate"), "ok")


@query("a16_llm_metrics", "SELECT conv_id, sum(length(text) // 4)::BIGINT AS total_tokens, round(coalesce(sum(length(text) // 4) FILTER (WHERE role = 'assistant'), 0) / (count(*) * 0.5), 6) AS tokens_per_s FROM conversations GROUP BY conv_id")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    t = txt.token_count(F.col("text"))
    g = T(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(t).alias("total_tokens"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", t)), F.lit(0)).alias("o"), F.count("*").alias("n"))
    return g.select("conv_id", "total_tokens", F.round(F.col("o") / (F.col("n") * 0.5), 6).alias("tokens_per_s"))


@query("a17_message_lists", "SELECT conv_id, list(role || ': ' || text ORDER BY turn, role) AS messages FROM conversations GROUP BY conv_id")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    g = T(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return g.select("conv_id", F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["text"])).alias("messages"))


@query("a18_queue_depth", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).count().na.fill(0)


@query("a19_first_descriptions", "SELECT source, substr(array_to_string(list_slice(list(text ORDER BY doc_id) FILTER (WHERE length(text) > 0), 1, 5), ' '), 1, 500) AS summary FROM documents GROUP BY source")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return op.first_texts(T(spark, sf, "documents"), "source", "doc_id", "text", 5, 500)


@query("a20_rolling_limits", f"SELECT user_id, event_type, count(*) FILTER (WHERE {_DAY}) AS n, count(*) FILTER (WHERE {_DAY}) >= 2 AS rejected FROM events GROUP BY ALL")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    n = jobs.sent_within(T(spark, sf, "events"), ["user_id", "event_type"], "ts", _then())
    return n.select("user_id", "event_type", F.col("sent").alias("n"), (F.col("sent") >= 2).alias("rejected"))


@query("a21_context_files", "SELECT source, list(doc_id ORDER BY doc_id) AS files, sum(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END)::BIGINT AS tokens FROM documents GROUP BY source")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    d = T(spark, sf, "documents").groupBy("source")
    return d.agg(F.array_sort(F.collect_list("doc_id")).alias("files"), F.sum(F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")), F.lit(0))).alias("tokens"))


# ---- budgets and histories
@query("k10_backfill", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents WHERE doc_id % 5 <> 0) WHERE r <= 4")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    d = T(spark, sf, "documents").select("source", "doc_id")
    cited = d.select("source", F.explode(F.array("doc_id", "doc_id")).alias("doc_id")).distinct()
    pinned = d.filter("doc_id % 5 = 0").select("doc_id")
    return op.recent(cited.join(pinned, "doc_id", "left_anti"), ["source"], "doc_id", 4).select("source", "doc_id")


_CUT = "CASE WHEN length({0}) // 4 > 54 THEN substr({0}, 1, 4 * greatest(0, ceil(length({0}) / 4.0)::INT // 2 - (length({0}) // 4 - 53) // 2)) || '\n\n--prompt truncated for brevity--\n\n' || substr({0}, 4 * (ceil(length({0}) / 4.0)::INT // 2 + (length({0}) // 4 - 53) // 2) + 1) ELSE {0} END"


@query(
    "k11_budgeted_history",
    f"""WITH RECURSIVE p AS (SELECT conv_id, turn, coalesce(max(CASE WHEN role = 'user' THEN text END), '') AS u, coalesce(max(CASE WHEN role <> 'user' THEN text END), '') AS a FROM conversations GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS nth, length(u) // 4 + length(a) // 4 AS cost, {_CUT.format("u")} AS su, {_CUT.format("a")} AS sa FROM p),
c AS (SELECT *, length(su) // 4 + length(sa) // 4 + 11 AS less FROM n),
r AS (SELECT DISTINCT conv_id, -1::BIGINT AS nth, 0::BIGINT AS used, 'start' AS fate FROM c
      UNION ALL
      SELECT conv_id, nth, used + CASE fate WHEN 'whole' THEN cost WHEN 'less' THEN less ELSE 0 END, fate
      FROM (SELECT c.conv_id, c.nth, r.used, c.cost, c.less, CASE WHEN r.used + c.cost < 120 THEN 'whole' WHEN c.nth > 2 THEN 'stop' WHEN r.used + c.less <= 120 THEN 'less' ELSE 'out' END AS fate
            FROM r JOIN c ON c.conv_id = r.conv_id AND c.nth = r.nth + 1 WHERE r.fate <> 'stop'))
SELECT c.conv_id, (row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1)::INT AS place, turn, CASE WHEN fate = 'less' THEN su ELSE u END AS user, CASE WHEN fate = 'less' THEN sa ELSE a END AS assistant
FROM r JOIN c USING (conv_id, nth) WHERE fate IN ('whole', 'less')""",
)
def k11(spark: SparkSession, sf: str) -> DataFrame:
    c = T(spark, sf, "conversations")
    pairs = c.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("u"), F.when(F.col("role") != "user", F.col("text")).alias("a"))
    pairs = pairs.groupBy("conv_id", "turn").agg(F.max("u").alias("u"), F.max("a").alias("a"))
    return op.budgeted_history(pairs, 120, "conv_id", "turn", "u", "a")


@query("k12_middle_out", "SELECT doc_id, CASE WHEN n < 40 THEN t ELSE list_slice(t, 1, (n // 2 - floor((n - 40) / 2.0 + 0.5))::INT) || ['...'] || list_slice(t, (n // 2 + floor((n - 40) / 2.0 + 0.5) + 1)::INT, n) END AS tokens FROM (SELECT doc_id, string_split(text, ' ') AS t, len(string_split(text, ' ')) AS n FROM documents)")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "documents").select("doc_id", txt.middle_out(F.split("text", " ", -1), 40, F.lit("...")).alias("tokens"))


@query("k14_hybrid_confidence", "SELECT vec_id, round(0.6 * v + 0.4 * g, 6) AS confidence FROM (SELECT vec_id, embedding[1]::DOUBLE AS v, CASE WHEN label % 2 = 0 THEN 0.8 ELSE 0.2 END AS g FROM embeddings)")
def k14(spark: SparkSession, sf: str) -> DataFrame:
    v = F.get("embedding", F.lit(0)).cast("double")
    g = F.when(F.col("label") % 2 == 0, 0.8).otherwise(0.2)
    return T(spark, sf, "embeddings").select("vec_id", F.round(0.6 * v + 0.4 * g, 6).alias("confidence"))


@query("k15_pinned_within", "SELECT source, doc_id FROM (SELECT source, doc_id, coalesce(sum(n_chars // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 2000")
def k15(spark: SparkSession, sf: str) -> DataFrame:
    d = T(spark, sf, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 4).alias("t"))
    return op.admit_within(d, ["doc_id"], F.col("t"), 2000, ["source"]).select("source", "doc_id")


@query("k16_recent_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def k16(spark: SparkSession, sf: str) -> DataFrame:
    return op.recent(T(spark, sf, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "role")


@query("k17_meeting_transcript", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS start, coalesce(json_extract_string(props, '$.speaker'), 'Unknown') AS speaker FROM events")
def k17(spark: SparkSession, sf: str) -> DataFrame:
    p = F.from_json("props", "k string, speaker string")
    return T(spark, sf, "events").select("event_id", F.coalesce(p["k"].try_cast("double"), F.lit(0.0)).alias("start"), F.coalesce(p["speaker"], F.lit("Unknown")).alias("speaker")).orderBy("start", "event_id")


# ---- keys, dates, costs
@query("m6_cache_keys", "SELECT conv_id, sha256('prompt' || array_to_string(list_sort(list(turn::VARCHAR)), '') || 'q') AS key FROM conversations GROUP BY conv_id")
def m6(spark: SparkSession, sf: str) -> DataFrame:
    g = T(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("string")).alias("ids"))
    return g.select("conv_id", governance.cache_key(F.lit("prompt"), F.col("ids"), F.lit("q")).alias("key"))


@query("m7_repeated_calls", "SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 3600000000, false) AS is_repeat FROM events")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    return governance.repeated_calls(T(spark, sf, "events"), ["user_id", "event_type"], "ts", 3600, "event_id").select("event_id", "is_repeat")


@query("m8_vram", "SELECT p_partkey, round((p_size * 1e9 * 2 / 1073741824.0 + 2.0 * 4096 * 4096 * 2 * 32 / 1073741824.0 * CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END) * 1.2, 6) AS gb FROM part")
def m8(spark: SparkSession, sf: str) -> DataFrame:
    from findling.operators.evaluation import vram_gb

    kv = F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(0.5)
    return T(spark, sf, "part").select("p_partkey", F.round(vram_gb(F.col("p_size"), F.lit(2.0), F.lit(32), F.lit(4096), F.lit(4096), kv), 6).alias("gb"))


@query("m9_cost", "SELECT doc_id, CASE WHEN n_chars * 100 * 0.0004 / 1000 >= 0.01 THEN '$' || format('{:.2f}', n_chars * 100 * 0.0004 / 1000) ELSE '< $0.01' END AS cost FROM documents")
def m9(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "documents").select("doc_id", governance.cost_text(F.col("n_chars") * 100).alias("cost"))


@query("m10_next_sync", "SELECT event_id, ts + INTERVAL 7 DAY AS next_sync FROM events")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "events").select("event_id", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(604800000) / 1000)).alias("next_sync"))


@query("m12_parse_iso", "SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN date_trunc('second', ts) END AS parsed FROM events")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 3 == 1, iso).otherwise("soon")
    return T(spark, sf, "events").select("event_id", governance.parse_iso(text).cast("timestamp_ntz").alias("parsed"))


@query("m13_entity_ids", f"SELECT c_custkey, {UUID5} AS id FROM (SELECT c_custkey, {UUID5_DIGEST.format("'ws:' || lower(c_name)")} AS s FROM customer)")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "customer").select("c_custkey", governance.entity_id(F.lit("ws"), F.upper("c_name")).alias("id"))


# ---- export and state
@query("s32_export_csv", """SELECT conv_id, turn, '"' || conv_id || '","' || role || '","' || replace(replace(text, '"', '""'), chr(10), ' ') || '"' AS line FROM conversations""")
def s32(spark: SparkSession, sf: str) -> DataFrame:
    from findling.operators.export import csv_lines

    c = T(spark, sf, "conversations")
    return csv_lines(c, ["conv_id", "role", "text"]).select("conv_id", "turn", "line")


@query("s32_export_alpaca", "SELECT conv_id, turn, 'You are helpful.' AS instruction, text AS input, NULL::VARCHAR AS output FROM conversations WHERE role = 'user'")
def s32_alpaca(spark: SparkSession, sf: str) -> DataFrame:
    from findling.operators.export import alpaca

    c = T(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"), F.lit("{}").alias("response"), F.lit(None).cast("string").alias("system"))
    return alpaca(c, "You are helpful.").select("conv_id", "turn", "instruction", "input", "output")


def _said(role: str, text: str) -> str:
    return f"""'{{"role":"{role}","content":[{{"type":"text","text":' || to_json({text})::VARCHAR || '}}]}}'"""


@query("s32_export_jsonl", f"""SELECT conv_id AS workspace_id, '{{"messages":[' || {_said("system", "'You are helpful.'")} || ',' || string_agg({_said("user", "text")} || ',' || {_said("assistant", "role")}, ',' ORDER BY turn) || ']}}' AS line FROM conversations GROUP BY conv_id""")
def s32_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    from findling.operators.export import jsonl

    c = T(spark, sf, "conversations").select(F.col("conv_id").alias("workspace_id"), F.col("turn").alias("id"), F.col("text").alias("prompt"), F.to_json(F.struct(F.col("role").alias("text"))).alias("response"), F.lit(None).cast("string").alias("system"))
    return jsonl(c, "You are helpful.")


@query("r7_sync_difference", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'add' WHEN doc_id % 4 = 1 THEN 'replace' WHEN doc_id % 4 = 2 THEN 'remove' ELSE 'keep' END AS action FROM documents")
def r7(spark: SparkSession, sf: str) -> DataFrame:
    d = T(spark, sf, "documents")
    old = d.filter("doc_id % 4 <> 0").select("doc_id", "text")
    new = d.filter("doc_id % 4 <> 2").select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return governance.sync_difference(old, new, "doc_id", "text")


@query("r7_prune_failures", "WITH g AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE event_type <> 'error') AS good FROM events GROUP BY user_id) SELECT e.user_id, count(*) AS failures FROM events e JOIN g USING (user_id) WHERE e.event_type = 'error' AND (g.good IS NULL OR (e.ts, e.event_id) > g.good) GROUP BY e.user_id HAVING count(*) >= 2")
def r7_prune(spark: SparkSession, sf: str) -> DataFrame:
    return governance.prune_failures(T(spark, sf, "events"), "user_id", F.col("event_type") == "error", ["ts", "event_id"], 2)
