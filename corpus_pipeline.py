"""From raw documents to packed training sequences.

Each stage reads what the one before has written and keeps its columns; the last
returns the pieces of the packed sequences. ``run`` deletes what a stage wrote for itself as soon as its
result is written; who calls stages one by one does so with :func:`findling.storage.release_all`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm.common import documents
from findling.llm.exact_dedup import unique_documents
from findling.llm.mixing import mixed_documents
from findling.llm.near_dedup import distinct_documents
from findling.llm.packing import pack_pieces, tokenise_pieces
from findling.llm.quality_rules import clean_documents
from findling.llm.queries import SEQUENCE, line_field, word_tokenizer
from findling.storage import discard, tables_now, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and whose lines are mostly content.

    Null, empty and wordless texts go; repeated rows and null identifiers are judged like any other.
    """
    return clean_documents(docs, line_field(spark, docs, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest identifier.

    Null counts as empty; a null identifier stays only where its group has no other, and one of repeated rows stays.
    """
    return unique_documents(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest identifier.

    Texts without words stay; null identifiers come last, and one of several rows with the smallest identifier stays.
    """
    return distinct_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that bring every source to its target; the null source is one.

    A text without words gives no copy. A copy that the budget cuts gets its own ``n_chars``, where there is that column.
    """
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in mixed.columns else mixed


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place, and a check sum of the ids.

    ``copy_id`` tells apart the rows of ``docs``, which hold one document as often as it was mixed in, so each copy's
    pieces can be put together again. Null and empty texts give the id that ends a document.
    """
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("copy_id"))
    pieces = tokenise_pieces(numbered, word_tokenizer(), SEQUENCE, carry=("copy_id",))
    return pack_pieces(pieces, SEQUENCE, order_cols=("doc_id", "copy_id", "start")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the labeller nor the tokenizer; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before = tables_now()
        result = stage(spark, docs, sf_dir)
        own = tables_now() - before
        docs = written(result, f"pipeline-{name}")
        discard(spark, own)
    return docs
