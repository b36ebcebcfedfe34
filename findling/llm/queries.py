"""The queries of this subpackage over the provided tables, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm import oracles
from findling.llm.common import documents
from findling.llm.exact_dedup import exact_dedup
from findling.llm.knn_quality import fit_neighbours, score_quality, training_sample
from findling.llm.mixing import mix_sources
from findling.llm.near_dedup import near_duplicates
from findling.llm.packing import pack_pieces, tokenise_pieces
from findling.llm.pii import KINDS as PII_KINDS
from findling.llm.pii import find_personal_data
from findling.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_beginnings
from findling.llm.quality_rules import labelled_sample, quality_rules, train_line_field
from findling.llm.secrets import SecretRule, find_secrets
from findling.llm.sharding import shuffle_into_shards
from findling.llm.spans import n_of, spelled
from findling.llm.topk_search import top_products
from findling.llm.url_filter import Rule, filter_urls
from findling.llm.whitening import whiten

N_SHARDS = 24
SEQUENCE = 4096

#: Site rules of the production list, then pattern rules for link farms and shops.
URL_RULES = (
    Rule("net/", "block", "site"),
    Rule("example.net/en/", "allow", "site"),
    Rule("example.com/de/", "block", "site"),
    Rule("org/fr/", "allow", "site"),
    Rule("||spam-farm.", "block"),
    Rule("||cheap-pills.", "block"),
    Rule("||casino-*.", "block"),
    Rule("/ads/", "block"),
    Rule("/login^", "block"),
)

#: The three base rules, then keys of known forms. `{16,}` and `{14,}` drop the short matches of `[0-9a-f]+` and `AKIA[A-Z0-9]+`.
SECRET_RULES = (
    SecretRule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]{14,}"),
    SecretRule("hex", r"[0-9a-f]{16,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    SecretRule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    SecretRule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("login", r"://[^/:@\x09-\x20]++:[^/:@\x09-\x20]++@"),
)
SECRET_BASE = ("assign", "access", "hex")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), carry=["doc_id"])


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenise_pieces(documents(spark, sf_dir), word_tokenizer(), SEQUENCE)
    # The result holds check sums, so they are what is placed; the pipeline places the ids themselves.
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_pieces(pieces, SEQUENCE).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def line_field(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The line labeller, trained on a bounded sample of the labelled documents."""
    sample = labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return train_line_field([t for t, _ in sample], [g for _, g in sample])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = quality_rules(docs, line_field(spark, docs, sf_dir))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return shuffle_into_shards(documents(spark, sf_dir).select("doc_id", "text"), N_SHARDS).select(
        "doc_id",
        (F.length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(find_personal_data(documents(spark, sf_dir).select("doc_id", "text")), "spans", PII_KINDS)


def op7_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(find_secrets(documents(spark, sf_dir).select("doc_id", "text"), SECRET_RULES, name="spans"), "spans", SECRET_BASE)


def _digest(found: DataFrame, spans: str, base: tuple[str, ...]) -> DataFrame:
    s = F.col(spans)
    return found.select("doc_id", *[n_of(s, k).alias(f"n_{k}") for k in base], F.sha2(spelled(s, base), 256).alias("base_sha256"), spelled(s).alias("spans"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest", carry=["doc_id"], sha="text_sha256")


def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    texts, labels, prior = training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    scored = score_quality(docs, fit_neighbours(texts, labels, prior))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    trie = prefix_trie(*with_shared_beginnings(turns))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256).cast("double"))
    return top_products(vectors.select("vec_id", whole.alias("embedding")), 5, F.col("vec_id") % 50 == 0)


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 8)
    each = white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("white", "explained")).alias("at", "one"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("one.white").alias("whitened"), F.col("one.explained").alias("explained"), "identity_error")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_pack, op3_quality_rules, op4_near_dedup, op5_shard, op6_find_pii, op7_find_secrets, op8_exact_dedup, op9_filter_urls, op10_knn_quality, op11_prefix_trie, op12_topk_search, op13_whiten)}

ORACLES = oracles.ORACLES
