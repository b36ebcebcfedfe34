"""Document status, rate and sync as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from findling.session import ship

#: Steps of a document in order; a step is never taken back.
STEPS = ("pending", "queued", "processing", "completed", "failed")
DAYS_7_MS = 7 * 24 * 3600 * 1000


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The furthest step of a document; state that nothing touches for seven days of event time is dropped."""
    if state.hasTimedOut:
        state.remove()
        return
    status, n, last = state.get if state.exists else ("pending", 0, 0)
    for frame in frames:
        frame = frame.sort_values("ts", kind="stable")
        n += len(frame)
        last = max(last, int(frame["ts"].max().timestamp() * 1000))
        for s in frame["status"]:
            if s in STEPS and (STEPS.index(s) > STEPS.index(status) or (status, s) == ("failed", "queued")):
                status = s
    state.update((status, n, last))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + DAYS_7_MS)
    yield pd.DataFrame({"document_id": [key[0]], "status": [status], "events": [n]})


def document_status(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(document_id, status, events) after each batch of (document_id, status, ts); a failed document may be queued again.

    Time is that of the events: a timeout by the clock would keep a stream that runs until there is nothing new from ending.
    """
    ship(events.sparkSession)
    out = "document_id string, status string, events long"
    timed = events.withWatermark("ts", late)
    return timed.groupBy("document_id").applyInPandasWithState(_advance, out, "status string, events long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def final_status(events: DataFrame, folder: str, late: str = "1 hour") -> DataFrame:
    """The last status of each document once all there is has been read; batches are kept under ``folder`` by number."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/status/batch={number}")

    query = document_status(events, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = events.sparkSession.read.schema("document_id string, status string, events long, batch int").parquet(f"{folder}/status")
    return seen.groupBy("document_id").agg(F.max_by("status", F.struct("batch", "events")).alias("status"), F.max("events").alias("events"))


def windowed_counts(events: DataFrame, time_col: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events per window and type; what comes later than ``late`` is left out."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, size), "event_type").agg(F.count("*").alias("n"))


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything there is, batch by batch; ``work`` gets each batch once its number is known, so it can be idempotent."""
    q = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_stream(files: DataFrame, store, embed: Callable[[DataFrame], DataFrame], size: int = 512, overlap: int = 50, name: str = "ingest"):
    """A ``work`` for :func:`run_batches`: redact, split, embed and append the texts of a batch (doc_id, text, workspace_id); ``name`` tells streams into one store apart."""
    from findling.operators.governance import redact
    from findling.operators.text import fixed_windows

    def work(batch: DataFrame, number: int) -> None:
        clean = batch.withColumn("text", redact(F.col("text")))
        chunks = fixed_windows(clean, size, overlap).select(F.concat_ws("_chunk_", F.col("doc_id").cast("string"), "chunk_no").alias("id"), "content", F.col("doc_id").cast("string").alias("document_id"), "workspace_id")
        store.append(embed(chunks), batch=(name, number))

    return work
