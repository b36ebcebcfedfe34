"""Queries over the graph of customers and parts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.operators import code, graph as op
from findling.operators.communities import communities
from findling.operators import tables
from findling.plans.registry import query
from findling.plans.tables import UUID5, UUID5_DIGEST, EDGES, ENTITIES, edges, entities
from findling.session import table
from findling.storage import written

_VISIBLE = "(SELECT id FROM ent WHERE layer_id IN ('default', 'public'))"
_WAYS = "(SELECT source_id AS a, target_id AS b FROM edg UNION ALL SELECT target_id, source_id FROM edg)"


@query("g1_upsert_entities", f"SELECT id, CASE WHEN id LIKE 'c%1' THEN 'Renamed ' || id ELSE name END AS name, type FROM {ENTITIES}")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf).select("id", "name", "type")
    new = e.filter("id LIKE 'c%1'").withColumn("name", F.concat(F.lit("Renamed "), "id"))
    return tables.upsert(e, new, ["id"])


@query("g2_upsert_relations", f"SELECT id, source_id, target_id, CASE WHEN weight > 1 THEN weight * 10 ELSE weight END AS weight FROM {EDGES}")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    # Written, for it is read twice.
    e = written(edges(spark, sf).select("id", "source_id", "target_id", "weight"), "relations")
    new = e.filter("weight > 1").withColumn("weight", F.col("weight") * 10)
    ghost = spark.sql("SELECT 'x' AS id, 'nobody' AS source_id, 'nothing' AS target_id, 1.0D AS weight")
    return op.upsert_relations(e, new.unionByName(ghost), entities(spark, sf), e.count() + new.count())


@query(
    "g3_local_search",
    f"WITH edg AS {EDGES}, ent AS {ENTITIES}, ways AS (SELECT w.a, w.b FROM {_WAYS} w JOIN {_VISIBLE} v ON v.id = w.b), s AS (SELECT id FROM {_VISIBLE} WHERE id IN ('c1', 'c4', 'c7')), one AS (SELECT DISTINCT b AS id FROM s JOIN ways ON a = id), two AS (SELECT DISTINCT b AS id FROM one JOIN ways ON a = id) SELECT id, 1 AS distance FROM one WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT id, 2 FROM two WHERE id NOT IN (SELECT id FROM s) AND id NOT IN (SELECT id FROM one)",
)
def g3(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.sql("SELECT explode(array('c1', 'c4', 'c7')) AS id")
    return op.local_search(entities(spark, sf), edges(spark, sf), seeds, 2)


@query(
    "g3_local_search_compat",
    f"WITH edg AS {EDGES}, ent AS {ENTITIES}, ways AS {_WAYS}, s AS (SELECT id FROM {_VISIBLE} WHERE id IN ('c1', 'c4', 'c7')), one AS (SELECT DISTINCT b AS id FROM s JOIN ways ON a = id), two AS (SELECT DISTINCT b AS id FROM one JOIN ways ON a = id) SELECT id, distance FROM (SELECT id, 1 AS distance FROM one WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT id, 2 FROM two WHERE id NOT IN (SELECT id FROM s) AND id NOT IN (SELECT id FROM one)) WHERE id IN {_VISIBLE}",
)
def g3_compat(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.sql("SELECT explode(array('c1', 'c4', 'c7')) AS id")
    return op.local_search(entities(spark, sf), edges(spark, sf), seeds, 2, strict_path=False)


@query("g6_components")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return op.components(edges(spark, sf))


@query("g6_nation_components", "WITH RECURSIVE e AS (SELECT DISTINCT 'n' || s_nationkey AS a, 's' || s_suppkey AS b FROM supplier), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS root FROM w UNION SELECT w.b, r.root FROM r JOIN w ON w.a = r.id) SELECT id, min(root) AS component FROM r GROUP BY id")
def g6_small(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return op.components(s.select(F.concat(F.lit("n"), "s_nationkey").alias("source_id"), F.concat(F.lit("s"), "s_suppkey").alias("target_id")))


@query("g7_communities")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    return communities(edges(spark, sf))


_NATIONS = "(SELECT 'n' || s_nationkey AS component, 's' || s_suppkey AS id, s_suppkey FROM supplier)"


@query("k13_g8_hub_split", f"SELECT id, component, degree, CASE WHEN n < 6 THEN 'whole' WHEN p <= n // 2 THEN 'hub' ELSE 'periphery' END AS part FROM (SELECT c.id, component, coalesce(d.n, 0) AS degree, count(*) OVER (PARTITION BY component) AS n, row_number() OVER (PARTITION BY component ORDER BY coalesce(d.n, 0) DESC, c.id) AS p FROM {_NATIONS} c LEFT JOIN (SELECT 's' || l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY l_suppkey) d ON d.id = c.id)")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("component"))
    sold = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("o"), "l_orderkey").alias("target_id"))
    return op.hub_split(members, sold)


@query("g4_k9_global_search", "SELECT component, members FROM (SELECT 'n' || s_nationkey AS component, count(*) AS members FROM supplier GROUP BY s_nationkey) ORDER BY members DESC, component LIMIT 5")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "supplier").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("component")).agg(F.count("*").alias("members"))
    return c.orderBy(F.col("members").desc(), "component").limit(5)


@query("g5_list_entities", f"SELECT id, type FROM {ENTITIES} WHERE type = 'PART'")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return tables.dynamic_filter(entities(spark, sf), type="PART", layer_id=None).select("id", "type")


@query("g9_merge_entities", f"SELECT CASE WHEN id IN ('c2', 'c3') THEN 'c1' ELSE id END AS id, arg_min(name, (id <> 'c1', id)) AS name, string_agg('about ' || id, '; ' ORDER BY id IN ('c2', 'c3'), id) AS description, count(*) AS n FROM {ENTITIES} GROUP BY 1")
def g9(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf).select("id", "name", "type", F.concat(F.lit("about "), "id").alias("description"), F.array("id").alias("source_documents"))
    merges = spark.sql("SELECT * FROM VALUES ('c2', 'c1'), ('c3', 'c1') AS t(source_id, target_id)")
    kept, _ = op.merge_entities(e, edges(spark, sf), merges)
    return kept.select("id", "name", "description", F.size("source_documents").cast("long").alias("n"))


@query("g9_merged_edges", f"SELECT id, CASE WHEN source_id IN ('c2', 'c3') THEN 'c1' ELSE source_id END AS source_id, target_id FROM {EDGES}")
def g9_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf).select("id", "name", "type", F.lit("").alias("description"), F.array("id").alias("source_documents"))
    merges = spark.sql("SELECT * FROM VALUES ('c2', 'c1'), ('c3', 'c1') AS t(source_id, target_id)")
    return op.merge_entities(e, edges(spark, sf), merges)[1].select("id", "source_id", "target_id")


@query("g12_entity_keys", f"SELECT id, {UUID5} AS entity_key FROM (SELECT id, {UUID5_DIGEST.format("'ws:' || lower(name)")} AS s FROM {ENTITIES})")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    from findling.operators.governance import entity_id

    return entities(spark, sf).select("id", entity_id(F.lit("ws"), F.col("name")).alias("entity_key"))


@query("g13_code_edges", "SELECT DISTINCT * FROM (SELECT coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'k' || p_size END, p_brand) AS source_id, 'f' || p_partkey AS target_id, CASE WHEN p_partkey % 3 = 0 THEN 'HAS_METHOD' ELSE 'CONTAINS' END AS type FROM part UNION ALL SELECT p_brand, 'mod' || p_size, 'IMPORTS' FROM part UNION ALL SELECT 'f' || p_partkey, 'call' || (p_partkey % 7), 'CALLS' FROM part)")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(
        F.concat(F.lit("f"), "p_partkey").alias("id"), F.col("p_brand").alias("file_path"), F.lit("function").alias("node_type"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("k"), "p_size")).alias("parent_id"),
        F.array(F.concat(F.lit("mod"), "p_size")).alias("imports"), F.array().cast("array<string>").alias("bases"), F.array(F.concat(F.lit("call"), F.col("p_partkey") % 7)).alias("calls"),
    )
    return op.code_edges(p)


@query("g15_visual_export", f"WITH edg AS {EDGES}, keep AS (SELECT id FROM {ENTITIES} WHERE layer_id = 'public') SELECT id, source_id, target_id FROM edg WHERE source_id IN (FROM keep) AND target_id IN (FROM keep)")
def g15(spark: SparkSession, sf: str) -> DataFrame:
    return op.inner_edges(edges(spark, sf), entities(spark, sf).filter("layer_id = 'public'")).select("id", "source_id", "target_id")


@query("g16_clear_workspace", f"SELECT id FROM {ENTITIES} WHERE layer_id <> 'layer_hr'")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).filter("layer_id <> 'layer_hr'").select("id")


@query("a4_graph_stats", f"SELECT (SELECT count(*) FROM {ENTITIES}) AS entities, (SELECT count(*) FROM {EDGES}) AS relations, ['CUSTOMER', 'PART'] AS types")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf).agg(F.count("*").alias("entities"), F.array_sort(F.collect_set("type")).alias("types"))
    r = edges(spark, sf).agg(F.count("*").alias("relations"))
    # Two one-row tables.
    return e.join(r, F.lit(True)).select("entities", "relations", "types")


@query("a8_a9_degrees", f"WITH edg AS {EDGES}, d AS (SELECT a AS id, count(*) AS degree FROM {_WAYS} GROUP BY a) SELECT id, degree, greatest(10, least(50, 5 * degree))::BIGINT AS size FROM d")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return op.degrees(edges(spark, sf)).withColumn("size", op.node_size(F.col("degree")).cast("long"))


@query("a10_dominant_type", "SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS dominant FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return op.dominant_type(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("a11_entity_dedup", "SELECT lower(trim(source)) AS key, arg_min(upper(source), doc_id) AS name, arg_min(lang, doc_id) AS type, arg_max(text, (length(text), -doc_id)) AS description FROM documents GROUP BY 1")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.upper("source").alias("name"), F.col("lang").alias("type"), F.col("text").alias("description"), "doc_id")
    return op.dedup_entities(d, "doc_id")


@query("a12_batch_dedup", "SELECT lower(lang) AS key, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.lower("lang").alias("key")).agg(F.min("doc_id").alias("first_doc"))


@query("j5_endpoint_resolution", f"WITH ent AS {ENTITIES} SELECT e.id, a.name AS source_name, b.name AS target_name FROM {EDGES} e JOIN ent a ON a.id = e.source_id JOIN ent b ON b.id = e.target_id")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    ent = entities(spark, sf)
    a, b = ent.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), ent.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return edges(spark, sf).join(a, "source_id").join(b, "target_id").select("id", "source_name", "target_name")


@query("j6_name_resolution", "SELECT 'c' || o_custkey AS source_id, o_orderkey FROM orders WHERE o_custkey % 2 = 0")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    names = table(spark, sf, "customer").select("c_custkey", F.upper("c_name").alias("n"))
    r = table(spark, sf, "orders").join(names, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("n").alias("source_entity"), F.col("n").alias("target_entity"))
    return op.resolve_names(r, c).select("source_id", "o_orderkey")


@query("j7_edge_semi_join", f"SELECT id FROM {EDGES} WHERE source_id IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 5000) AND target_id IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 20)")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    small = table(spark, sf, "part").filter("p_size < 20").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return op.inner_edges(edges(spark, sf), rich.unionByName(small)).select("id")


@query("j8_j14_community_members", "SELECT o_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING list_has_any(list(l_partkey), [1, 2, 3, 4, 5])")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    hit = li.filter("l_partkey BETWEEN 1 AND 5").select("l_orderkey")
    held = li.join(hit, "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    return held


#: A source file for each part, in five languages, that say the same: a class with a base, a method that calls, an import.
_SOURCES = {
    "py": "import {mod}\n# {name} {\nclass {cls}({base}):\n    def run(x):\n        return {call}('}', x)\n",
    "js": "import '{mod}';\n/* {name} { */ class {cls} extends {base} {\n  run(x) { return {call}(`}${x}`, /[{]/); }\n}\n",
    "ts": "import '{mod}';\nclass {cls} implements {base} { // {name} }\n  run(x: string): { a: number } { return {call}('{', x); }\n}\n",
    "go": "package p\nimport \"{mod}\"\n/* {name} { */\ntype {cls} struct {\n  {base}\n  x int\n}\nfunc (c *{cls}) run(x int) int { return {call}('}', x) }\n",
    "rs": "use {mod};\n/* {name} /* nested { */ */ struct {cls}<'a> { x: &'a str }\nimpl<'a> {base} for {cls}<'a> { fn run(x: i32) -> i32 { {call}(r#\"}\"#, x) } }\n",
}
_FILES = """(SELECT 'p' || p_partkey || '.' || list_extract(['py', 'js', 'ts', 'go', 'rs'], (p_partkey % 5 + 1)::INT) AS path, 'C' || p_size AS cls, 'B' || p_size % 9 AS base,
 'm' || right(p_brand, 1) AS mod, 'call' || p_partkey % 11 AS call FROM part)"""


@query("g14_code_edges", f"""SELECT path AS source_id, path || '::' || cls AS target_id, 'CONTAINS' AS type FROM {_FILES} UNION ALL SELECT path || '::' || cls, path || '::' || cls || '::run', 'HAS_METHOD' FROM {_FILES}
UNION ALL SELECT path, mod, 'IMPORTS' FROM {_FILES} UNION ALL SELECT path || '::' || cls, base, 'INHERITS' FROM {_FILES} UNION ALL SELECT path || '::' || cls || '::run', call, 'CALLS' FROM {_FILES}""")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    part = table(spark, sf, "part").select(
        F.concat(F.lit("p"), "p_partkey", F.lit("."), F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("file_path"), F.concat(F.lit("C"), "p_size").alias("cls"), F.concat(F.lit("B"), (F.col("p_size") % 9).cast("string")).alias("base"),
        F.concat(F.lit("m"), F.right("p_brand", F.lit(1))).alias("mod"), F.concat(F.lit("call"), (F.col("p_partkey") % 11).cast("string")).alias("call"), text("p_name").alias("name")
    )
    written = F.lit(None)
    for ext, form in _SOURCES.items():
        pieces = re.split(r"\{(mod|name|cls|base|call)\}", form)
        body = F.concat(*[F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(pieces)])
        written = F.when(F.endswith("file_path", F.lit("." + ext)), body).otherwise(written)
    return op.code_edges(code.code_chunks(part.select("file_path", written.alias("text"))).filter("error IS NULL"))

