"""Queries over the store of chunks, jobs, model steps with deterministic stand-ins, readers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.operators import governance, graph, jobs, models
from findling.plans.registry import ORACLES, query
from findling.plans import text_queries  # noqa: F401  its SQL is used here
from findling.plans.tables import CHUNKS, ENTITIES, chunks, entities
from findling.session import table, table_stream
from findling.sources.store import ChunkStore
from findling.storage import folder

AS_OF = "2024-01-31 00:00:00"


def _store(spark: SparkSession, rows: DataFrame) -> ChunkStore:
    store = ChunkStore(spark, folder(spark, "store"), 4)
    store.append(rows)
    return store


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", "content", "document_id", "workspace_id", "layer_id", "visibility")


# ---- the store
@query("s2_s3_append_defaults", f"SELECT id, content, coalesce(CASE WHEN doc_id % 5 <> 0 THEN layer_id END, 'default') AS layer_id, coalesce(CASE WHEN doc_id % 7 <> 0 THEN visibility END, 'private') AS visibility, []::VARCHAR[] AS access_roles, '{{}}' AS metadata FROM {CHUNKS}")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf).withColumns({"layer_id": F.when(F.col("doc_id") % 5 != 0, F.col("layer_id")), "visibility": F.when(F.col("doc_id") % 7 != 0, F.col("visibility"))})
    return _store(spark, c.select("id", "content", "document_id", "workspace_id", "layer_id", "visibility")).read().select("id", "content", "layer_id", "visibility", "access_roles", "metadata")


@query("s7_update_chunks", f"SELECT id, CASE WHEN doc_id % 10 = 0 AND workspace_id = 'src1' THEN 'new ' || id ELSE content END AS content, layer_id FROM {CHUNKS}")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    store = _store(spark, _kept(spark, sf))
    patch = c.filter("doc_id % 10 = 0").select("id", F.concat(F.lit("new "), "id").alias("content"))
    store.update("src1", patch, ("content",))
    return store.read().select("id", "content", "layer_id")


@query("s8_delete_chunk", f"SELECT id FROM {CHUNKS} WHERE NOT (chunk_no = 0 AND workspace_id = 'src1')")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, _kept(spark, sf))
    store.delete("src1", chunks(spark, sf).filter("chunk_no = 0").select("id"))
    return store.read().select("id")


@query("s9_delete_document", f"SELECT count(*) FILTER (WHERE doc_id % 4 = 1) AS removed, count(*) FILTER (WHERE doc_id % 4 <> 1) AS remaining FROM {CHUNKS} WHERE workspace_id = 'src1'")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, _kept(spark, sf))
    gone = table(spark, sf, "documents").filter("doc_id % 4 = 1").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"))
    removed = store.delete("src1", gone, "document_id")
    return store.read().filter("workspace_id = 'src1'").agg(F.lit(removed).cast("long").alias("removed"), F.count("*").alias("remaining"))


@query("s10_drop_collection", f"SELECT workspace_id, count(*) AS n FROM {CHUNKS} WHERE workspace_id <> 'src1' GROUP BY workspace_id")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, _kept(spark, sf))
    store.drop("src1")
    return store.read().groupBy("workspace_id").agg(F.count("*").alias("n"))


@query("s11_switch_table", f"SELECT count(*) AS n FROM {CHUNKS} WHERE layer_id = 'public'")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    blue, green = _store(spark, _kept(spark, sf)), _store(spark, _kept(spark, sf).filter("layer_id = 'public'"))
    pointer = f"{folder(spark, 'active')}/chunks"
    blue.activate(pointer)
    green.activate(pointer)
    return ChunkStore.active(spark, pointer).read().agg(F.count("*").alias("n"))


@query("s36_add_documents", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR length(trim(text)) = 0 THEN 0 ELSE greatest(1, ceil((length(text) - 200) / 800.0))::BIGINT END AS chunks, CASE WHEN doc_id % 6 = 0 THEN 'registered' WHEN length(trim(text)) = 0 THEN 'failed' ELSE 'embedded' END AS status FROM documents")
def s36(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("workspace_id"), F.when(F.col("doc_id") % 6 == 0, "archive://x").otherwise("file://x").alias("path"))
    return jobs.add_documents(ChunkStore(spark, folder(spark, "store"), 8), docs, models.hash_embedder(8))


# ---- jobs
@query("r3_rate_limit", "SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts NULLS FIRST, event_id NULLS FIRST) <= 5 AS is_admitted FROM events")
def r3(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.admitted(table(spark, sf, "events"), "user_id", "ts", "event_id", 5, 86_400).select("event_id", "is_admitted")


@query("r4_live_entries", f"SELECT e.event_id FROM events e LEFT JOIN (SELECT user_id, max(ts) AS w FROM events WHERE event_type = 'purchase' GROUP BY user_id) p USING (user_id) WHERE event_type = 'view' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY AND ts <= TIMESTAMP '{AS_OF}' AND (w IS NULL OR w < ts)")
def r4(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    writes = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("written"))
    return jobs.live_entries(e.filter("event_type = 'view'"), writes, "user_id", "ts", "written", 864_000, F.to_timestamp(F.lit(AS_OF))).select("event_id")


_STEP = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'pending' END"


@query("r1_document_status", f"SELECT user_id::VARCHAR AS document_id, ['pending', 'queued', 'processing', 'completed'][max(list_position(['pending', 'queued', 'processing', 'completed'], {_STEP}))] AS status, count(*) AS events FROM events GROUP BY user_id")
def r1(spark: SparkSession, sf: str) -> DataFrame:
    from findling.streaming.state import final_status

    return final_status(table_stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("document_id"), F.expr(_STEP).alias("status"), F.col("ts").cast("timestamp").alias("ts")), folder(spark, "status"))


@query("r1_status_history", ORACLES["r1_document_status"])
def r1_history(spark: SparkSession, sf: str) -> DataFrame:
    from findling.streaming.documents import status_with_history

    rows = table_stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("document_id"), F.expr(_STEP).alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return status_with_history(rows, folder(spark, "history")).select("document_id", "status", "events")


@query("t21_think_fragments", "SELECT conv_id || '-' || turn AS id, text AS visible, role AS thought FROM conversations")
def t21_fragments(spark: SparkSession, sf: str) -> DataFrame:
    from findling.streaming.documents import think_stream

    said = table_stream(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("<think>"), "role", F.lit("</think>"), "text").alias("t"))
    last = F.floor((F.length("t") - 1) / 9).cast("long")
    cut = said.withColumn("last", last).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    parts = think_stream(cut.select("id", "seq", F.substring(F.col("t"), (F.col("seq") * 9 + 1).cast("int"), F.lit(9)).alias("fragment"), (F.col("seq") == F.col("last")).alias("is_last")), folder(spark, "thoughts"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), "").alias(c)
    return parts.groupBy("id").agg(joined("visible"), joined("thought"))


#: Nations with their suppliers, then with their regions; every fifth supplier and the first region leave again.
_CHANGES = "SELECT 'n' || s_nationkey AS a, 's' || s_suppkey AS b FROM supplier WHERE s_suppkey % 5 > 0 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_regionkey > 0"


@query("g11_incremental_components", f"WITH RECURSIVE e AS ({_CHANGES}), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM w UNION SELECT w.b, r.root FROM r JOIN w ON w.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def g11_incremental(spark: SparkSession, sf: str) -> DataFrame:
    from findling.streaming.components import IncrementalComponents

    named = lambda t, a, b: t.select(F.concat(F.lit(a[0]), a[1]).alias("source_id"), F.concat(F.lit(b[0]), b[1]).alias("target_id"))
    sold = named(table(spark, sf, "supplier"), ("n", "s_nationkey"), ("s", "s_suppkey"))
    lie = named(table(spark, sf, "nation"), ("n", "n_nationkey"), ("r", "n_regionkey"))
    fifth = named(table(spark, sf, "supplier").filter("s_suppkey % 5 = 0"), ("s", "s_suppkey"), ("n", "s_nationkey"))
    index = IncrementalComponents(spark, folder(spark, "graph"))
    for number, (rows, gone) in enumerate(((sold, False), (lie, False), (fifth.unionByName(lie.filter("target_id = 'r0'")), True))):
        index.apply(rows.withColumns({"is_deleted": F.lit(gone), "seq": F.lit(0)}), number)
    return index.members()


def _late():
    """Fails at first on texts of some lengths, and always on others."""

    def embed(text: str, n: int) -> list[float]:
        if len(text) % 11 == 0 or len(text) % 3 == 0 and n == 1:
            raise RuntimeError("not now")
        return [float(len(text))]

    return embed


@query(
    "r2_document_chain",
    f"""SELECT doc_id, CASE WHEN n % 11 = 0 OR n % 3 = 0 AND batch = 2 THEN 'failed' ELSE 'completed' END AS status, (CASE WHEN n % 11 = 0 THEN 3 - batch WHEN n % 3 = 0 AND batch < 2 THEN 2 ELSE 1 END)::INT AS tries
FROM (SELECT doc_id, coalesce(length(redacted), 0) AS n, doc_id % 3 AS batch FROM ({ORACLES["c2_redact"]}))""",
)
def r2_chain(spark: SparkSession, sf: str) -> DataFrame:
    from findling.streaming.documents import DocumentChain

    docs = table(spark, sf, "documents").select("doc_id", "text")
    chain = DocumentChain(spark, folder(spark, "chain"), _late(), lambda text: [w for w in text.split()[:8] if w[:1].isupper()])
    for number in range(3):
        chain.apply(docs.filter(F.col("doc_id") % 3 == number), number)
    return chain.documents().select("doc_id", "status", "tries")


@query("r1_latest_state", "SELECT user_id AS document_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated FROM events GROUP BY user_id")
def r1_latest(spark: SparkSession, sf: str) -> DataFrame:
    last = governance.latest_state(table(spark, sf, "events"), "user_id", "ts", "event_id", ["event_type"])
    return last.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated"))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("community"), F.col("s_suppkey").alias("entity_id"))


@query("g10_stale_communities", "SELECT DISTINCT 'n' || s_nationkey AS community FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 10 = 1)")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    m = _members(spark, sf)
    return jobs.affected_communities(m, m.filter("entity_id % 3 = 0"), m.filter("entity_id % 10 = 1"))


@query("r6_stale_round", "SELECT community, community NOT IN (SELECT community FROM (SELECT DISTINCT 'n' || s_nationkey AS community FROM supplier ORDER BY community LIMIT 5) WHERE community NOT LIKE '%1') AS stale FROM (SELECT DISTINCT 'n' || s_nationkey AS community FROM supplier)")
def r6(spark: SparkSession, sf: str) -> DataFrame:
    stale = _members(spark, sf).select("community").distinct()
    renewed, left = jobs.stale_round(stale, lambda taken: taken.filter("community NOT LIKE '%1'"), 5)
    return renewed.select("community", F.lit(False).alias("stale")).unionByName(left.select("community", F.lit(True).alias("stale")))


def _flaky():
    """Fails once on texts of odd length, and always on every third one."""

    def embed(text: str, n: int) -> list[float]:
        if len(text) % 3 == 0 or len(text) % 2 and n == 1:
            raise RuntimeError("not now")
        return [float(n), 0.0, 0.0, float(len(text))]

    return embed


@query("r8_update_saga", f"SELECT id, (CASE WHEN length(id) % 3 = 0 THEN 3 ELSE length(id) % 2 + 1 END)::INT AS tries, CASE WHEN length(id) % 3 = 0 THEN 'sync_error' ELSE 'committed' END AS sync_status, CASE WHEN length(id) % 3 = 0 THEN content ELSE id END AS content FROM {CHUNKS} WHERE workspace_id = 'src2'")
def r8(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, _kept(spark, sf))
    patches = chunks(spark, sf).filter("workspace_id = 'src2'").select("id", F.col("id").alias("content"))
    return jobs.update_chunks(store, "src2", patches, _flaky).join(store.read().select("id", "content"), "id")


# ---- model steps
_COMMUNITY = f"(SELECT layer_id AS community, id, name, type, CASE WHEN length(name) % 2 = 0 AND layer_id <> 'default' THEN name || ' of ' || type END AS description FROM {ENTITIES})"


def _described(spark: SparkSession, sf: str) -> DataFrame:
    told = F.when((F.length("name") % 2 == 0) & (F.col("layer_id") != "default"), F.concat("name", F.lit(" of "), "type"))
    return entities(spark, sf).select(F.col("layer_id").alias("community"), "id", "name", "type", told.alias("description"))


_SUMMARIES = f"""
SELECT community, type || ' Community (' || size || ' entities)' AS title, substr(coalesce(told, 'Community of ' || size || ' ' || type || ' entities'), 1, 500) AS summary, size
FROM (SELECT community, sum(n)::BIGINT AS size, arg_min(type, (-n, type)) AS type FROM (SELECT community, type, count(*) AS n FROM {_COMMUNITY} GROUP BY ALL) GROUP BY community)
LEFT JOIN (SELECT community, array_to_string(list_slice(list(description ORDER BY id), 1, 5), ' ') AS told FROM {_COMMUNITY} WHERE description IS NOT NULL GROUP BY community) USING (community)
"""


@query("e6_community_summaries", _SUMMARIES)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return models.community_summaries(_described(spark, sf))


@query("e7_community_index", f"SELECT 'community-' || community AS id, title || chr(10) || summary AS content, 'w' AS workspace_id, 8 AS dimension FROM ({_SUMMARIES})")
def e7(spark: SparkSession, sf: str) -> DataFrame:
    index = models.community_index(models.community_summaries(_described(spark, sf)), models.hash_embedder(8), "w")
    store = ChunkStore(spark, folder(spark, "store"), 8)
    store.append(index)
    return store.read().select("id", "content", "workspace_id", F.size("embedding").alias("dimension"))


def _intent():
    """Names intents by the length of a question and fails on every fifth one."""

    def named(text: str) -> str:
        if len(text) % 5 == 0:
            raise RuntimeError("no answer")
        return ("factual", "Thematic ", "research", "small talk")[len(text) % 4]

    return named


@query("e4_intent_routes", "SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN 'HYBRID' ELSE ['VECTOR', 'GRAPH', 'RESEARCH', 'HYBRID'][length(text) % 4 + 1] END AS route FROM (SELECT conv_id, turn, regexp_replace(text, '[A-Za-z]', 'x', 'g') AS text FROM conversations)")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("text", F.regexp_replace("text", "[A-Za-z]", "x"))
    return models.intent_routes(c, _intent).select("conv_id", "turn", "route")


@query("e10_reembed", "SELECT item_id, 'v2' AS model_version, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 16 END AS dimension FROM benchmark")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("content"), F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>").alias("embedding"), F.when(F.col("item_id") % 3 == 0, "v2").when(F.col("item_id") % 3 == 1, "v1").alias("model_version"))
    return jobs.reembedded(old, models.hash_embedder(16), "v2").select("item_id", "model_version", F.size("embedding").alias("dimension"))


@query("r2_vector_to_graph", "SELECT 'embedded' AS status, count(*) AS n FROM documents WHERE length(trim(text)) > 0 GROUP BY ALL UNION ALL SELECT 'entity', count(DISTINCT lower(lang)) FROM documents WHERE length(trim(text)) > 0")
def r2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter(F.length(F.trim("text")) > 0).select("doc_id", "text", "lang", F.lit("w").alias("workspace_id"), F.lit("file://x").alias("path"))
    status = jobs.add_documents(ChunkStore(spark, folder(spark, "store"), 8), docs, models.hash_embedder(8))
    found = docs.select(F.col("lang").alias("name"), F.lit("LANG").alias("type"), F.lit("").alias("description"), "doc_id")
    named = graph.dedup_entities(found, "doc_id").select(F.lit("entity").alias("status"))
    return status.select("status").unionByName(named).groupBy("status").agg(F.count("*").alias("n"))
