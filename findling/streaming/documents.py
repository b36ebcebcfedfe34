"""Documents on their way through a pipeline, with state that expires, and texts that come in fragments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from findling.session import ship
from findling.streaming.components import IncrementalComponents
from findling.streaming.state import DAYS_7_MS, STEPS

#: State that expires and lists need this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN, CLOSE = "<think>", "</think>"


class StatusProcessor(StatefulProcessor):
    """The furthest step of a document and the steps it took; both expire ``ttl_ms`` after their last change."""

    def __init__(self, ttl_ms: int = DAYS_7_MS):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._now = handle.getValueState("now", "status string, events long", self._ttl_ms)
        self._steps = handle.getListState("steps", "status string, ts timestamp", self._ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, n = self._now.get() if self._now.exists() else ("pending", 0)
        taken = []
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            n += 1
            if row.status in STEPS and (STEPS.index(row.status) > STEPS.index(status) or (status, row.status) == ("failed", "queued")):
                status = row.status
                taken.append((status, row.ts.to_pydatetime()))
        self._now.update((status, n))
        if taken:
            self._steps.appendList(taken)
        path = [s for s, _ in self._steps.get()] if self._steps.exists() else []
        yield pd.DataFrame({"document_id": [key[0]], "status": [status], "events": [n], "path": [">".join(path)]})

    def close(self) -> None:
        pass


class ThoughtsProcessor(StatefulProcessor):
    """Tells what stands between think tags from the rest, in fragments cut anywhere.

    The state is whether a tag is open and the beginning of a tag at the end of what came so far: fewer characters than a tag has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "inside boolean, held string, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        inside, held, _ = self._state.get() if self._state.exists() else (False, "", -1)
        frames = list(rows)
        # Lists, for a key has few fragments: sorting and walking a frame costs more than they do.
        given = sorted(zip(*[[v for f in frames for v in f[c].tolist()] for c in ("seq", "fragment", "is_last")], strict=True), key=lambda r: r[0])
        seqs, seen, thoughts = [], [], []
        for seq, fragment, is_last in given:
            visible, thought, inside, held = parsed(fragment or "", inside, held)
            if is_last:
                visible, thought, held = (visible, thought + held, "") if inside else (visible + held, thought, "")
            seqs.append(seq)
            seen.append(visible)
            thoughts.append(thought)
        self._state.update((inside, held, int(seqs[-1])))
        yield pd.DataFrame({"id": [key[0]] * len(seqs), "seq": seqs, "visible": seen, "thought": thoughts})

    def close(self) -> None:
        pass


def parsed(fragment: str, inside: bool, held: str) -> tuple[str, str, bool, str]:
    """What a fragment adds outside and inside of tags, and the state after it."""
    text, parts = held + fragment, {False: [], True: []}
    while True:
        tag = CLOSE if inside else OPEN
        at = text.find(tag)
        if at < 0:
            break
        parts[inside].append(text[:at])
        text, inside = text[at + len(tag) :], not inside
    # The longest end that may begin the tag looked for.
    keep = next(n for n in range(min(len(tag) - 1, len(text)), -1, -1) if text.endswith(tag[:n]))
    parts[inside].append(text[: len(text) - keep])
    return "".join(parts[False]), "".join(parts[True]), inside, text[len(text) - keep :]


def _run(stream: DataFrame, folder: str, schema: str) -> DataFrame:
    """All there is of ``stream``; batches are kept under ``folder`` by number, so one that is run again replaces itself."""
    spark = stream.sparkSession
    # A clock ends state, so batches without data would go on for ever.
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/rows")


def status_with_history(events: DataFrame, folder: str, ttl_ms: int = DAYS_7_MS) -> DataFrame:
    """(document_id, status, events, path) once all events (document_id, status, ts) there are have been read; state lives ``ttl_ms``.

    Called again with the same folder it goes on from its checkpoint: events that were read aren't read again.
    """
    ship(events.sparkSession)
    schema = "document_id string, status string, events long, path string"
    rows = _run(events.groupBy("document_id").transformWithStateInPandas(StatusProcessor(ttl_ms), schema, "Update", "ProcessingTime"), folder, schema)
    return rows.groupBy("document_id").agg(F.max_by(F.struct("status", "events", "path"), "batch").alias("last")).select("document_id", "last.*")


def think_stream(fragments: DataFrame, folder: str) -> DataFrame:
    """(id, seq, visible, thought) of fragments (id, seq, fragment, is_last): what each adds outside and inside of think tags.

    A fragment's last characters come with a later one where they may begin a tag. Fragments of one id come in order of ``seq``.
    """
    ship(fragments.sparkSession)
    schema = "id string, seq long, visible string, thought string"
    return _run(fragments.groupBy("id").transformWithStateInPandas(ThoughtsProcessor(), schema, "Update", "None"), folder, schema).drop("batch")


class DocumentChain:
    """Ingest, embed, extract and graph for batches of a stream of (doc_id, text), each kept by its number under ``folder``.

    ``embed`` turns a text into a vector and ``extract`` into names, both may raise: such a document fails, is queued again with the next
    batch, and given up after ``tries``. The names of a document are edges of a graph whose components follow.
    """

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[str, int], list[float]], extract: Callable[[str], list[str]], tries: int = 3):
        self.spark, self.folder, self.tries, self._work = spark, folder.rstrip("/"), tries, (embed, extract)
        self.graph = IncrementalComponents(spark, f"{self.folder}/graph")

    _SCHEMA = "doc_id long, text string, tries int, vector array<double>, names array<string>, status string"

    def apply(self, batch: DataFrame, number: int) -> None:
        from findling.operators.governance import redact

        ship(self.spark)
        docs = batch.select("doc_id", redact(F.coalesce("text", F.lit(""))).alias("text"), F.lit(1).alias("tries"))
        if number:
            again = self.spark.read.schema(f"{self._SCHEMA}, batch int").parquet(f"{self.folder}/documents").filter((F.col("batch") == number - 1) & (F.col("status") == "failed") & (F.col("tries") < self.tries))
            docs = docs.unionByName(again.select("doc_id", "text", (F.col("tries") + 1).alias("tries")))
        embed, extract = self._work

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for doc_id, text, n in frame.itertuples(index=False):
                    try:
                        out.append((doc_id, text, n, embed(text, n), sorted(set(extract(text))), "completed"))
                    except Exception:
                        out.append((doc_id, text, n, None, None, "failed"))
                yield pd.DataFrame(out, columns=["doc_id", "text", "tries", "vector", "names", "status"])

        path = f"{self.folder}/documents/batch={number}"
        docs.mapInPandas(run, self._SCHEMA).write.mode("overwrite").parquet(path)
        done = self.spark.read.schema(self._SCHEMA).parquet(path).filter("status = 'completed'")
        edges = done.select(F.concat(F.lit("d"), "doc_id").alias("source_id"), F.explode("names").alias("name"))
        self.graph.apply(edges.select("source_id", F.concat(F.lit("e:"), "name").alias("target_id"), F.lit(False).alias("is_deleted"), F.lit(0).alias("seq")), number)

    def documents(self) -> DataFrame:
        """The last state of each document."""
        rows = self.spark.read.schema(f"{self._SCHEMA}, batch int").parquet(f"{self.folder}/documents")
        return rows.groupBy("doc_id").agg(F.max_by(F.struct("status", "tries", "vector", "names"), "batch").alias("last")).select("doc_id", "last.*")
