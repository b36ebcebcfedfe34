"""Steps that need a model, as seams: the model is a function that the caller brings.

A model runs in Arrow batches on the executors, is loaded once for each worker and never
sees the driver. What stands around it (batches, cuts, fallbacks, validation) is here.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.operators.graph import dedup_entities, resolve_names
from findling.session import ship

Embedder = Callable[[list[str]], list[list[float]]]


def hash_embedder(dimension: int = 64) -> Callable[[], Embedder]:
    """A deterministic embedder by hashed words, for tests and dry runs."""

    def load() -> Embedder:
        def embed(texts: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                v = [0.0] * dimension
                for word in text.lower().split():
                    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                    v[h % dimension] += 1.0 if h >> 63 else -1.0
                n = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([x / n for x in v])
            return out

        return embed

    return load


def embed_texts(rows: DataFrame, load: Callable[[], Embedder], text_col: str = "content", name: str = "embedding", batch: int = 100) -> DataFrame:
    """``name``: the vector of each text. ``load`` runs once a task; null texts have no vector."""
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c != name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch].copy()
                texts = part[text_col]
                have = texts.notna()
                vectors = iter(model(texts[have].tolist())) if have.any() else iter(())
                part[name] = pd.Series([next(vectors) if h else None for h in have], index=part.index, dtype=object)
                yield part

    return rows.select(*kept).mapInPandas(run, rows.select(*kept).schema.add(name, T.ArrayType(T.FloatType())))


def extract_entities(chunks: DataFrame, load: Callable[[], Callable[[str], list[dict]]], most_chars: int = 4000) -> DataFrame:
    """Entities (name, type, description, source_chunk_id, confidence) that a model finds in each chunk (id, content); blank chunks are skipped.

    A model gets at most ``most_chars`` characters at once; a longer chunk goes to it window by window, whole.
    """
    ship(chunks.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            rows = [(e.get("name"), e.get("type"), e.get("description"), key, float(e.get("confidence", 1.0))) for key, text in zip(frame["id"], frame["content"], strict=True) if text and text.strip() for i in range(0, len(text), most_chars) for e in model(text[i : i + most_chars]) if e.get("name")]
            yield pd.DataFrame(rows, columns=["name", "type", "description", "source_chunk_id", "confidence"])

    return chunks.select("id", "content").mapInPandas(run, "name string, type string, description string, source_chunk_id string, confidence double")


def map_reduce(rows: DataFrame, by: str, text_col: str, order_col: str, work: Callable[[str], str], batch: int = 10) -> DataFrame:
    """``work`` over batches of texts of a group, then over the results of its batches: two rounds of bounded calls."""
    ship(rows.sparkSession)
    kind = rows.schema[by].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({by: frame[by], "n": frame["n"], "text": [work(t) for t in frame["text"]]})

    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order_col)
    one = rows.select(by, F.col(text_col).alias("t"), F.col(order_col).alias("o"), F.floor((F.row_number().over(w) - 1) / batch).alias("n"))
    joined = one.groupBy(by, "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n\n").alias("text"))
    first = joined.mapInPandas(run, f"{by} {kind}, n long, text string")
    last = first.groupBy(by).agg(F.lit(0).cast("long").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return last.mapInPandas(run, f"{by} {kind}, n long, text string").select(by, F.col("text").alias("summary"))


def index_document(entities: DataFrame, relations: DataFrame, known: DataFrame, order_col: str, layer_id: str) -> tuple[DataFrame, DataFrame]:
    """New (entities, relations) of a document: names joined, ids resolved against the known and the new ones, layer stamped."""
    from findling.operators.governance import entity_id

    fresh = dedup_entities(entities, order_col).withColumn("id", entity_id(F.lit(layer_id), F.col("key"))).withColumn("layer_id", F.lit(layer_id))
    names = known.select("id", "name").unionByName(fresh.select("id", "name"))
    names = names.groupBy(F.lower("name").alias("k")).agg(F.min_by("name", "id").alias("name"), F.min("id").alias("id")).drop("k")
    return fresh, resolve_names(relations, names).withColumn("layer_id", F.lit(layer_id))


#: Entities named in a prompt, descriptions of a summary without a model, and the most characters of both.
PROMPTED, DESCRIBED, SUMMARY_CHARS, TITLE_CHARS = 20, 5, 500, 50


def community_summaries(members: DataFrame, load: Callable[[], Callable[[str], dict]] | None = None) -> DataFrame:
    """(community, title, summary, size) of members (community, id, name, type, description).

    A model gets the first described members by identifier and answers ``title`` and ``summary``. Without one, or where it
    fails, the summary is made of the first descriptions, or of the size and the most frequent type (of equally frequent
    ones the first by name). Only so many members of a community as a prompt takes are ever gathered.
    """
    from pyspark.sql import Window

    ship(members.sparkSession)
    kinds = members.groupBy("community", "type").agg(F.count("*").alias("n"))
    about = kinds.groupBy("community").agg(F.sum("n").alias("size"), F.min(F.struct(-F.col("n"), F.col("type"))).alias("k")).select("community", "size", F.col("k.type").alias("type"))
    w = Window.partitionBy("community").orderBy("id")
    first = members.filter(F.coalesce("description", F.lit("")) != "").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= PROMPTED)
    told = first.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "name", "type", "description"))).alias("told"))
    plain = F.array_join(F.slice(F.transform("told", lambda x: x["description"]), 1, DESCRIBED), " ")
    none = F.concat(F.lit("Community of "), F.col("size"), F.lit(" "), F.col("type"), F.lit(" entities"))
    rows = about.join(told, "community", "left").select(
        "community",
        "size",
        F.concat(F.col("type"), F.lit(" Community ("), F.col("size"), F.lit(" entities)")).alias("title"),
        F.substring(F.coalesce(plain, none), 1, SUMMARY_CHARS).alias("summary"),
        F.concat_ws("\n", none, F.array_join(F.transform("told", lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ("), x["type"], F.lit("): "), x["description"])), "\n")).alias("prompt"),
    )
    if load is None:
        return rows.select("community", "title", "summary", "size")
    kind = members.schema["community"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(r) -> tuple:
            try:
                got = model(r.prompt)
                return str(got["title"])[:TITLE_CHARS], str(got["summary"])[:SUMMARY_CHARS]
            except Exception:  # noqa: BLE001  any failure of a model means the summary without one
                return r.title, r.summary

        for frame in frames:
            made = [one(r) for r in frame.itertuples()]
            yield pd.DataFrame({"community": frame["community"], "title": [t for t, _ in made], "summary": [t for _, t in made], "size": frame["size"]})

    return rows.mapInPandas(run, f"community {kind}, title string, summary string, size long")


def community_index(summaries: DataFrame, load: Callable[[], Embedder], workspace: str, layer: str = "default") -> DataFrame:
    """Summaries as chunks of the store, one each, under ``community-`` and its name."""
    named = summaries.select(
        F.concat(F.lit("community-"), F.col("community").cast("string")).alias("id"),
        F.concat_ws("\n", "title", "summary").alias("content"),
        F.lit(workspace).alias("workspace_id"),
        F.lit(layer).alias("layer_id"),
        F.to_json(F.struct("size")).alias("metadata"),
    )
    return embed_texts(named, load)


#: What a model calls a question, and where it goes.
INTENT_ROUTES = {"factual": "VECTOR", "thematic": "GRAPH", "research": "RESEARCH", "agentic": "RESEARCH", "code_generation": "VECTOR"}
OTHER_INTENT = "HYBRID"


def intent_routes(questions: DataFrame, load: Callable[[], Callable[[str], str]], text_col: str = "text") -> DataFrame:
    """``questions`` with ``route``: of the intent that a model names, or by keywords where the model fails."""
    from findling.operators.text import route

    ship(questions.sparkSession)
    source = questions.withColumn("route", route(F.col(text_col)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(text, fallback: str) -> str:
            try:
                return INTENT_ROUTES.get(model(text).strip().lower(), OTHER_INTENT)
            except Exception:  # noqa: BLE001  any failure of a model means the keywords
                return fallback

        for frame in frames:
            yield frame.assign(route=[one(t, r) for t, r in zip(frame[text_col], frame["route"], strict=True)])

    return source.mapInPandas(run, source.schema)
