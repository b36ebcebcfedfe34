"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.functions import urls
from findling.operators import governance, text as op
from findling.plans.registry import query
from findling.session import table
from findling.sources import crawl, formats

D = lambda spark, sf: table(spark, sf, "documents")

_HTML = r"regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs'), '<[^>]+>', ' ', 'g')"


@query("s16_html_text", rf"SELECT page_id, trim(regexp_replace({_HTML}, '\s+', ' ', 'g')) AS content FROM pages")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", op.html_text(F.col("html")).alias("content"))


@query("t2_recursive_chunks")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    return op.split_texts(D(spark, sf), "recursive", 1000, 200)


def _joined(parts: str) -> str:
    """The joining of a document's ``parts`` with overlap, and the search for the chunks, step by step in DuckDB SQL."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {parts} AS parts FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
p AS (SELECT doc_id, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM d),
r AS (
  SELECT doc_id, n, 1::BIGINT AS i, part AS held, NULL::VARCHAR AS done, 0 AS chunks FROM p WHERE i = 1
  UNION ALL
  SELECT doc_id, n, i + 1,
         CASE WHEN part IS NULL THEN NULL WHEN fits THEN held || ' ' || part WHEN length(tail || ' ' || part) > 1000 THEN part ELSE tail || ' ' || part END,
         CASE WHEN part IS NULL OR NOT fits THEN held END, chunks + CASE WHEN part IS NULL OR NOT fits THEN 1 ELSE 0 END
  FROM (SELECT r.*, p.part, length(held) + length(p.part) <= 1000 AS fits, CASE WHEN length(held) > 200 THEN right(held, 200) ELSE held END AS tail
        FROM r LEFT JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1 WHERE r.i <= r.n)),
c AS (SELECT doc_id, chunks - 1 AS chunk_no, done AS content FROM r WHERE done <> ''),
o AS (
  SELECT doc_id, -1 AS chunk_no, NULL::VARCHAR AS content, 0::BIGINT AS start_offset, 0::BIGINT AS next FROM d
  UNION ALL
  SELECT doc_id, chunk_no, content, start, greatest(start + 1, start + length(content) - 200)
  FROM (SELECT o.doc_id, c.chunk_no, c.content, CASE WHEN instr(substr(d.text, o.next + 1), c.content) > 0 THEN o.next + instr(substr(d.text, o.next + 1), c.content) - 1 ELSE o.next END AS start
        FROM o JOIN c ON c.doc_id = o.doc_id AND c.chunk_no = o.chunk_no + 1 JOIN d ON d.doc_id = o.doc_id))
SELECT doc_id, chunk_no::INT AS chunk_no, content, length(content)::INT AS char_count, (length(content) // 4)::INT AS token_count, start_offset::INT AS start_offset, (start_offset + length(content))::INT AS end_offset
FROM o WHERE chunk_no >= 0
"""


@query("t3_sentence_chunks", _joined(r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"))
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return op.split_texts(D(spark, sf), "sentence", 1000, 200)


@query("t3_paragraph_chunks", _joined(r"list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"))
def t3p(spark: SparkSession, sf: str) -> DataFrame:
    return op.split_texts(D(spark, sf), "paragraph", 1000, 200)


@query("t4_sentence_split", r"SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS sentences FROM documents")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", op.sentences(F.col("text")).alias("sentences"))


@query("t5_paragraph_split", r"SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) > 0) AS paragraphs FROM documents")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", op.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("paragraphs"))


@query("t6_fixed_windows", "SELECT doc_id, i::INT AS chunk_no, substr(text, (i * 800 + 1)::INT, 1000) AS content, (i * 800)::INT AS start FROM (SELECT *, unnest(range(0, greatest(1, ceil((length(text) - 200) / 800.0)::INT))) AS i FROM documents WHERE length(text) > 0)")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    return op.fixed_windows(D(spark, sf), 1000, 200).select("doc_id", "chunk_no", "content", F.col("start").cast("int").alias("start"))


@query("t7_chunk_offsets")
def t7(spark: SparkSession, sf: str) -> DataFrame:
    return op.split_texts(D(spark, sf), "recursive", 512, 50).select("doc_id", "chunk_no", "start_offset", "end_offset")


@query("t8_token_count", "SELECT doc_id, (length(text) // 4)::INT AS tokens, CASE WHEN (length(text) * 2) // 1024 >= 10 THEN ceil(length(text) / 8.0) ELSE length(text) // 4 END::INT AS collector_tokens FROM documents")
def t8(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", op.token_count(F.col("text")).alias("tokens"), op.collector_tokens(F.col("text")).alias("collector_tokens"))


@query("t10_message_tokens", "SELECT conv_id, (3 * count(*) + sum(length(text) // 4) + 5)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def t10(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").groupBy("conv_id")
    return t.agg((3 * F.count("*") + F.sum(op.token_count(F.col("text"))) + 5).alias("tokens"))


@query("t11_chunk_header", "SELECT doc_id, '<document_metadata>' || chr(10) || 'sourceDocument: Document ' || doc_id || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'published: 2024-01-0' || (doc_id % 9 + 1) || chr(10) ELSE '' END || CASE doc_id % 3 WHEN 0 THEN 'source: https://' || source || chr(10) WHEN 1 THEN 'source: v/' || source || chr(10) ELSE '' END || '</document_metadata>' || chr(10) || chr(10) AS header FROM documents")
def t11(spark: SparkSession, sf: str) -> DataFrame:
    origin = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("link://https://"), "source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("youtube://v/"), "source")).otherwise(F.concat(F.lit("file://"), "source"))
    published = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"))).otherwise("")
    return D(spark, sf).select("doc_id", op.header(F.concat(F.lit("Document "), "doc_id"), published, origin).alias("header"))


@query("t12_max_chunk_size", "SELECT doc_id, least(n_chars, 1000) AS size FROM documents")
def t12(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", F.least("n_chars", F.lit(1000)).cast("long").alias("size"))


@query("t13_counts", r"SELECT doc_id, length(text)::INT AS chars, len(list_filter(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> ''))::INT AS words FROM documents")
def t13(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", F.length("text").alias("chars"), op.word_count(F.col("text")).alias("words"))


@query("t14_strip_controls", "SELECT doc_id, text AS clean FROM documents")
def t14(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", op.strip_controls(F.concat(F.lit("\x00\x07"), F.col("text"), F.lit("\x1f"))).alias("clean"))


@query("t15_csv_escape", """SELECT conv_id, turn, '"' || replace(replace(text, '"', '""'), chr(10), ' ') || '"' AS field FROM conversations""")
def t15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", op.csv_field(F.col("text")).alias("field"))


@query("t16_template", "SELECT conv_id, turn, 'Hello ' || role || ', turn ' || turn || ' of {other}' AS filled FROM conversations")
def t16(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", op.expand_template(F.lit("Hello {role}, turn {turn} of {other}"), {"role": F.col("role"), "turn": F.col("turn").cast("string")}).alias("filled"))


@query("t17_json_path", "SELECT event_id, coalesce(props->>'$.k', '') AS k, coalesce(json_extract_string(props, '$.missing.x'), '') AS missing FROM events")
def t17(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", governance.json_value(F.col("props"), "k").alias("k"), governance.json_value(F.col("props"), "missing['x']").alias("missing"))


@query("t18_repair_json", "SELECT event_id, '[' || props || ']' AS fixed FROM events")
def t18(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit("["), "props", F.lit("]"))
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(body)
    return table(spark, sf, "events").select("event_id", op.repair_json(answer).alias("fixed"))


@query("t19_parse_intent", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'THEMATIC' WHEN 1 THEN 'AGENTIC' ELSE 'FACTUAL' END AS intent, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM events")
def t19(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    said = F.when(k == 0, '<think>hm</think> {"intent": "thematic", "confidence": 1.7}').when(k == 1, 'So: {"intent": "agent"}').when(k == 2, "no idea").otherwise('{"intent": "UNKNOWN", "confidence": -1}')
    return table(spark, sf, "events").select("event_id", op.parse_intent(said).alias("p")).select("event_id", "p.intent", "p.confidence")


@query("t20_breadcrumb", "SELECT p_partkey, 'File: ' || p_brand || ' > Class: ' || p_type AS crumb FROM part")
def t20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("File: "), "p_brand", F.lit(" > "), F.initcap(F.lit("class")), F.lit(": "), "p_type").alias("crumb"))


@query("t21_think_tags", "SELECT conv_id, turn, role AS thought, text AS answer FROM (SELECT conv_id, turn, role, trim(text) AS text FROM conversations)")
def t21(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("<think>"), "role", F.lit("</think>"), "text")
    c = table(spark, sf, "conversations").withColumn("said", said)
    return c.select("conv_id", "turn", F.element_at(F.regexp_extract_all("said", F.lit("(?s)<think>(.*?)</think>"), F.lit(1)), 1).alias("thought"), op.without_thoughts(F.col("said")).alias("answer"))


@query("t22_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def t22(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", op.preview(F.col("text")).alias("preview"))


@query("t23_source_identifier", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'title:' || source || '-timestamp:' || n_chars END AS ident FROM documents")
def t23(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 4 != 0, F.col("source"))
    return D(spark, sf).select("doc_id", op.source_identifier(title, F.col("n_chars").cast("string")).alias("ident"))


_WORDS = lambda words: " + ".join(f"contains(q, '{w}')::INT" for w in words)
_ASKED = "CASE conv_id % 3 WHEN 0 THEN 'What is the detail of this step? ' WHEN 1 THEN 'Compare every relationship between ' ELSE '' END"


@query("t24_keyword_router", f"SELECT conv_id, turn, CASE WHEN g > v + 1 THEN 'GRAPH' WHEN v > g + 1 THEN 'VECTOR' ELSE 'HYBRID' END AS route FROM (SELECT conv_id, turn, {_WORDS(op.GRAPH_WORDS)} AS g, {_WORDS(op.VECTOR_WORDS)} AS v FROM (SELECT conv_id, turn, lower({_ASKED} || text) AS q FROM conversations))")
def t24(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", op.route(F.concat(F.expr(_ASKED), "text")).alias("route"))


@query("t25_code_intent", "SELECT conv_id, turn, contains(lower(text), 'function') OR contains(lower(text), 'class') OR contains(lower(text), 'code') OR contains(lower(text), 'implement') AS is_code FROM conversations")
def t25(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.contains(low, F.lit("function")) | F.contains(low, F.lit("class")) | F.contains(low, F.lit("code")) | F.contains(low, F.lit("implement"))).alias("is_code"))


@query("t26_summary_pieces", "SELECT doc_id, count(*) AS pieces, sum(length(c))::BIGINT AS chars FROM (SELECT doc_id, unnest(list_transform(range(0, greatest(1, ceil((length(text) - 500) / 9500.0)::INT)), lambda i: substr(text, (i * 9500 + 1)::INT, 10000))) AS c FROM documents WHERE length(text) > 0) GROUP BY doc_id")
def t26(spark: SparkSession, sf: str) -> DataFrame:
    return op.fixed_windows(D(spark, sf), 10000, 500).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("content")).alias("chars"))


@query("p15_capitalised_words", r"SELECT doc_id, list_filter(string_split(text, ' '), lambda w: length(w) > 3 AND regexp_matches(w, '^\p{Lu}')) AS names FROM documents")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", F.filter(F.split("text", " ", -1), lambda w: (F.length(w) > 3) & F.rlike(w, F.lit(r"^\p{Lu}"))).alias("names"))


_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "ip": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
    "phone": r"\+[0-9][0-9() .-]{8,}[0-9]", "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
}
#: The checks in DuckDB SQL. A wallet would need arithmetic on 200 bits: tests by hand hold those, the tables have none.
_GOOD = {
    "iban": "list_reduce(list_prepend(0, list_transform(range(1, length(m) + 1), lambda i: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(substr(m, 5) || substr(m, 1, 4), i, 1)) - 1)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: p::INT > 255)) = 0",
    "card": "list_sum(list_transform(range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i, 1)::INT ELSE (2 * substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i, 1)::INT) // 10 + (2 * substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i, 1)::INT) % 10 END)) % 10 = 0",
}


def _checked(kind: str, name: str, source: str) -> str:
    return f"{name} AS (SELECT doc_id, array_to_string(list_transform(list_zip(string_split_regex(t, '{_PATTERNS[kind]}'), regexp_extract_all(t, '{_PATTERNS[kind]}')), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' WHEN list_transform([z[2]], lambda m: {_GOOD[kind]})[1] THEN '<{name.upper()}>' ELSE z[2] END), '') AS t FROM {source})"


@query(
    "c2_redact",
    f"""WITH mail AS (SELECT doc_id, regexp_replace(text, '{_PATTERNS["email"]}', '<EMAIL_ADDRESS>', 'g') AS t FROM documents), {_checked("iban", "iban", "mail")}, {_checked("ip", "ip_address", "iban")},
phone AS (SELECT doc_id, regexp_replace(t, '{_PATTERNS["phone"]}', '<PHONE_NUMBER>', 'g') AS t FROM ip_address), {_checked("card", "credit_card", "phone")} SELECT doc_id, t AS redacted FROM credit_card""",
)
def c2(spark: SparkSession, sf: str) -> DataFrame:
    return D(spark, sf).select("doc_id", governance.redact(F.col("text")).alias("redacted"))


_N = lambda kind: f"len(list_filter(regexp_extract_all(text, '{_PATTERNS[kind]}'), lambda m: {_GOOD.get(kind, 'true')}))::INT"


@query("c1_pii_counts", f"SELECT doc_id, {_N('email')} AS emails, {_N('iban')} AS ibans, {_N('ip')} AS ips, {_N('phone')} AS phones, {_N('card')} AS cards, 0::INT AS wallets FROM documents")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    found = D(spark, sf).select("doc_id", governance.detect(F.col("text")).alias("found"))
    names = {"EMAIL_ADDRESS": "emails", "IBAN_CODE": "ibans", "IP_ADDRESS": "ips", "PHONE_NUMBER": "phones", "CREDIT_CARD": "cards", "CRYPTO_WALLET": "wallets"}
    return found.select("doc_id", *[F.size(F.col("found")[kind]).alias(name) for kind, name in names.items()])


@query("c3_secret_scan", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)(password|secret|token|api_?key)[ ]*[:=]|AKIA[A-Z0-9]{16}|-----BEGIN [A-Z ]*PRIVATE KEY')")
def c3(spark: SparkSession, sf: str) -> DataFrame:
    return governance.without_secrets(D(spark, sf)).select("doc_id")


@query("s15_s19_detect_format", "SELECT page_id, 'html' AS by_mime, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'html' ELSE 'txt' END AS by_name, 'html' AS by_magic FROM pages")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("f."), F.element_at(F.array(F.lit("pdf"), F.lit("DOCX"), F.lit("htm"), F.lit("log")), (F.col("page_id") % 4 + 1).cast("int")))
    none = F.lit(None).cast("string")
    return table(spark, sf, "pages").select(
        "page_id",
        formats.detect(F.lit("text/html; charset=utf-8"), none, F.col("html")).alias("by_mime"),
        formats.detect(none, name, F.lit("plain")).alias("by_name"),
        formats.detect(none, none, F.col("html")).alias("by_magic"),
    )


@query("s20_dispatch", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'mbox' END AS parser, page_id % 3 <> 2 AS success FROM pages")
def s20(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("x."), F.element_at(F.array(F.lit("pdf"), F.lit("mbox"), F.lit("exe")), (F.col("page_id") % 3 + 1).cast("int")))
    return formats.dispatch(table(spark, sf, "pages").select("page_id", name.alias("name")), "name").select("page_id", "parser", "success")


@query("s17_csv_rows", "SELECT n_nationkey, n_nationkey || ' | ' || n_name || ' | ' || n_regionkey AS line FROM nation")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    return formats.joined_rows(table(spark, sf, "nation")).select("n_nationkey", "line")


@query("s18_json_pretty", "SELECT event_id, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("valid"))


@query("s25_site_links", r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def s25(spark: SparkSession, sf: str) -> DataFrame:
    return formats.links(table(spark, sf, "pages")).select("page_id", "link").distinct()


@query("s26_valid_url", r"SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AND NOT regexp_matches(url, '^https?://(192|172|10)\.[0-9]+\.[0-9]+\.[0-9]+([:/?#]|$)') AS valid, regexp_replace(CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END, '/$', '') AS normal FROM pages")
def s26(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.is_valid(F.col("url")).alias("valid"), urls.normalise(F.col("url")).alias("normal"))


@query("s27_youtube_id", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN lpad(page_id::VARCHAR, 11, 'a') END AS video FROM pages")
def s27(spark: SparkSession, sf: str) -> DataFrame:
    ident = F.lpad(F.col("page_id").cast("string"), 11, "a")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://youtu.be/"), ident)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("www.youtube.com/watch?t=1&v="), ident, F.lit("&x=1"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", urls.youtube_id(url).alias("video"))


#: A site for each registered name: its pages, and a listing for each first folder, which links to the pages under it.
_SITE, _FOLDER, _PATH = r"([^./:?#]+[.][^./:?#]+)(?:[/?#]|$)", r"://[^/?#]*(/[^/?#]+)", r"://[^/?#]*([^#]*)"
_START = "http://example.org/de"
SITE_LINKS = rf"""
(SELECT src, dst, min(position) AS position FROM (
   SELECT src, 'http://' || site || link AS dst, i AS position FROM (
     SELECT 'http://' || site || path AS src, site, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS i FROM (
       SELECT regexp_extract(url, '{_SITE}', 1) AS site, regexp_extract(url, '{_PATH}', 1) AS path, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages))
   UNION ALL
   SELECT 'http://' || regexp_extract(url, '{_SITE}', 1) || regexp_extract(url, '{_FOLDER}', 1), 'http://' || regexp_extract(url, '{_SITE}', 1) || regexp_extract(url, '{_PATH}', 1), page_id FROM pages)
 GROUP BY src, dst)
"""


def _reached(depth: int, columns: str, end: str) -> str:
    """Breadth first by the least path of places: level by level, so that nodes met again later don't matter."""
    return f"""
WITH RECURSIVE l AS (SELECT src, dst, lpad(position::VARCHAR, 12, '0') || ' ' || dst AS step FROM {SITE_LINKS} WHERE starts_with(dst, 'http://example.org/')),
r AS (
  SELECT '{_START}' AS url, 0 AS depth, ['']::VARCHAR[] AS way
  UNION ALL
  SELECT dst, any_value(depth) + 1, min(list_append(way, step)) FROM r JOIN l ON src = url WHERE depth < {depth} GROUP BY dst)
SELECT {columns} FROM (SELECT url, min(depth)::INT AS depth, arg_min(way, depth) AS way FROM r GROUP BY url) {end}
"""


def _site_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    root = F.concat(F.lit("http://"), part(_SITE))
    site = pages.select("page_id", F.concat(root, part(_PATH)).alias("url"), F.concat(root, part(_FOLDER)).alias("listing"), "html")
    listed = site.select(F.col("listing").alias("src"), F.col("url").alias("dst"), F.col("page_id").alias("position"))
    return crawl.page_links(site).unionByName(listed).groupBy("src", "dst").agg(F.min("position").alias("position"))


@query("s25_crawl", _reached(4, "url, depth, row_number() OVER (ORDER BY depth, way) - 1 AS place", "ORDER BY depth, way LIMIT 200"))
def s25_crawl(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.crawl(_site_links(spark, sf), _START, 4, most=200, scope="http://example.org/")


@query("s25_reachable", _reached(6, "url, depth", ""))
def s25_reachable(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.crawl(_site_links(spark, sf), _START, 6, scope="http://example.org/").select("url", "depth")
