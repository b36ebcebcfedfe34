"""Background work over documents: limits, caches, stale summaries, updates with retries, indexing of new documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.operators.models import embed_texts
from findling.operators.text import fixed_windows
from findling.session import ship
from findling.sources.store import ChunkStore

#: Tries of a step before its row is given up.
MOST_TRIES = 3


def admitted(requests: DataFrame, by: str, time_col: str, order_col: str, most: int = 5, seconds: int = 60) -> DataFrame:
    """Requests with ``is_admitted``: the first ``most`` of each ``seconds`` of a caller."""
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    # Whole seconds would be cut towards 1970, so a slot is where it begins.
    slot = at - F.pmod(at, F.lit(seconds * 1_000_000))
    w = Window.partitionBy(by, slot).orderBy(time_col, order_col)
    return requests.withColumn("is_admitted", F.row_number().over(w) <= most)


def sent_within(rows: DataFrame, by: list[str], time_col: str, as_of: Column, hours: int = 24) -> DataFrame:
    """``sent``: rows of each key in the ``hours`` before ``as_of``, which belongs to them; keys without any have 0."""
    recent = (F.col(time_col) > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col(time_col) <= as_of)
    return rows.groupBy(*by).agg(F.count_if(recent).alias("sent"))


def live_entries(entries: DataFrame, writes: DataFrame, by: str, set_col: str, write_col: str, seconds: int, as_of: Column) -> DataFrame:
    """Cache entries younger than ``seconds`` in whose group nothing was written since they were set."""
    last = writes.groupBy(by).agg(F.max(write_col).alias("last_write"))
    young = entries.filter((F.col(set_col) > as_of - F.make_dt_interval(secs=F.lit(seconds))) & (F.col(set_col) <= as_of))
    return young.join(last, by, "left").filter(F.col("last_write").isNull() | (F.col("last_write") < F.col(set_col))).drop("last_write")


def affected_communities(members: DataFrame, changed: DataFrame, renewed: DataFrame) -> DataFrame:
    """Communities (``community``) that hold a changed entity and have not been renewed since."""
    return members.join(changed.select("entity_id"), "entity_id", "left_semi").select("community").distinct().join(renewed.select("community"), "community", "left_anti")


def stale_round(stale: DataFrame, renew: Callable[[DataFrame], DataFrame], most: int = 100, order_col: str = "community") -> tuple[DataFrame, DataFrame]:
    """(renewed rows, what stays stale): the first ``most`` are taken, those that ``renew`` gives no row for come back."""
    taken = stale.orderBy(order_col).limit(most)
    renewed = renew(taken)
    return renewed, stale.join(renewed.select("community"), "community", "left_anti")


def embed_with_retries(rows: DataFrame, load: Callable[[], Callable[[str, int], list[float]]], text_col: str = "content", tries: int = MOST_TRIES) -> DataFrame:
    """``rows`` with ``embedding``, ``tries`` and ``sync_status``: ``committed``, or ``sync_error`` after ``tries`` failures.

    ``load`` gives a function of a text and the number of the try; whatever it raises fails that try of that row only.
    """
    ship(rows.sparkSession)
    schema = rows.schema[:].add("embedding", T.ArrayType(T.FloatType())).add("tries", "integer").add("sync_status", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(text: str) -> tuple:
            for n in range(1, tries + 1):
                try:
                    return model(text, n), n, "committed"
                except Exception:  # noqa: BLE001  any failure of a model is one of its row
                    continue
            return None, tries, "sync_error"

        for frame in frames:
            done = [one(t) for t in frame[text_col]]
            yield frame.assign(**{name: pd.Series([d[i] for d in done], index=frame.index, dtype=kind) for i, (name, kind) in enumerate((("embedding", object), ("tries", "int32"), ("sync_status", object)))})

    return rows.mapInPandas(run, schema)


def update_chunks(store: ChunkStore, workspace: str, patches: DataFrame, load: Callable[[], Callable[[str, int], list[float]]], tries: int = MOST_TRIES) -> DataFrame:
    """Embed new contents (id, content), write those that succeed in one step, and return (id, tries, sync_status) of all."""
    from findling.storage import written

    done = written(embed_with_retries(patches, load, tries=tries), "updates")
    store.update(workspace, done.filter("sync_status = 'committed'").select("id", "content", "embedding"))
    return done.select("id", "tries", "sync_status")


def add_documents(store: ChunkStore, docs: DataFrame, load, size: int = 1000, overlap: int = 200, archive: str = "archive://", batch: int = 100) -> DataFrame:
    """Split, embed and append documents (doc_id, path, text, workspace_id); (doc_id, chunks, status) from what arrived.

    Documents under ``archive`` are ``registered`` without vectors; of the others, those with chunks in the store are
    ``embedded`` and those without ``failed``.
    """
    remote = F.startswith("path", F.lit(archive))
    texts = docs.filter(~remote & (F.length(F.trim("text")) > 0))
    split = fixed_windows(texts, size, overlap).select(
        F.concat_ws("_chunk_", F.col("doc_id").cast("string"), "chunk_no").alias("id"), "content", F.col("doc_id").cast("string").alias("document_id"), "workspace_id"
    )
    store.append(embed_texts(split, load, batch=batch))
    arrived = store.read().filter("embedding IS NOT NULL").groupBy(F.col("document_id").alias("doc")).agg(F.count("*").alias("chunks"))
    out = docs.join(arrived, docs["doc_id"].cast("string") == arrived["doc"], "left")
    status = F.when(remote, "registered").when(F.col("chunks") > 0, "embedded").otherwise("failed")
    return out.select("doc_id", F.coalesce(F.when(~remote, F.col("chunks")), F.lit(0)).alias("chunks"), status.alias("status"))


def reembedded(chunks: DataFrame, load, version: str, version_col: str = "model_version", batch: int = 100) -> DataFrame:
    """All chunks with vectors of ``version``: those of another one, or of none, are embedded anew."""
    old = ~F.col(version_col).eqNullSafe(F.lit(version))
    new = embed_texts(chunks.filter(old).drop("embedding"), load, batch=batch).withColumn(version_col, F.lit(version))
    return chunks.filter(~old).unionByName(new)
