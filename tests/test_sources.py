import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from findling.sources import connectors, formats, sql
from findling.sources.store import ChunkStore, validate, with_defaults
from findling.streaming import state


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é text".encode("latin-1"))
    (tmp_path / "b.json").write_text('{"x": [1]}')
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    (tmp_path / "d.html").write_text("<style>x</style><p>Hi <b>you</b></p>")
    (tmp_path / "e.exe").write_text("?")
    (tmp_path / "f.mbox").write_text("From a@b Thu Jan  1 00:00:00 2024\nSubject: One\n\nbody one\n\nFrom a@b Thu Jan  1 00:00:00 2024\nSubject: Two\n\nbody two\n")
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="x"><w:body><w:p><w:t>Para</w:t></w:p><w:tbl><w:tr><w:tc><w:t>l</w:t></w:tc><w:tc><w:t>r</w:t></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "g.docx").write_bytes(word.getvalue())
    rows = {(r["path"].rsplit("/", 1)[1], r["part"]): r for r in formats.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt", 0]["content"] == "é text"
    assert rows["b.json", 0]["content"].startswith("{\n")
    assert rows["c.csv", 0]["content"] == "a | b\n1 | 2"
    assert rows["d.html", 0]["content"] == "Hi you"
    assert "unsupported" in rows["e.exe", 0]["error"]
    assert [rows["f.mbox", i]["title"] for i in (0, 1)] == ["One", "Two"]
    assert rows["g.docx", 0]["content"] == "Para\n\nl | r"


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), 2)
    rows = spark.createDataFrame([("1", "a", [1.0, 0.0], "d1", "w1"), ("2", "b", [0.0, 1.0], "d2", "w2"), ("3", "c", [0.0, 1.0], "d1", "w1")], "id string, content string, embedding array<float>, document_id string, workspace_id string")
    store.append(rows)
    got = store.read()
    validate(with_defaults(got))
    assert {r["layer_id"] for r in got.collect()} == {"default"} and got.count() == 3
    assert store.delete("w1", spark.createDataFrame([("1",)], "id string")) == 1
    store.update("w1", spark.createDataFrame([("3", "new", None)], "id string, content string, embedding array<float>"))
    assert {(r["id"], r["content"]) for r in store.read().collect()} == {("2", "b"), ("3", "new")}
    with pytest.raises(Exception, match="2 numbers"):
        store.append(rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))


_ROW = "id string, content string, embedding array<float>, document_id string, workspace_id string"


def test_store_versions(spark, tmp_path):
    def rows(*ids, workspace="w1"):
        return spark.createDataFrame([(i, i, [1.0], f"d{i}", workspace) for i in ids], _ROW)

    def ids(df):
        return sorted(r["id"] for r in df.collect())

    store = ChunkStore(spark, str(tmp_path / "s"), 1)
    assert ids(store.read()) == []
    store.append(rows("1", "2"), batch=("s", 0))
    store.append(rows("1", "2"), batch=("s", 0))
    store.append(rows("3", workspace=None))
    before, held = store.version(), store.read()
    assert store.delete("w1", spark.createDataFrame([("1",)], "id string")) == 1
    assert ids(store.read()) == ["2", "3"]
    assert ids(held) == ids(store.read(before)) == ["1", "2", "3"]
    with pytest.raises(Exception, match="1 numbers"):
        store.append(rows("4").withColumn("embedding", F.array().cast("array<float>")))
    assert ids(store.read()) == ["2", "3"]
    store.drop("w1")
    store.append(rows("5"))
    store.compact()
    assert ids(store.read()) == ["3", "5"] and len(store.version()["parts"]) == 1
    assert store.vacuum() >= 4 and ids(store.read()) == ["3", "5"]


def test_switch_outlives_the_session(spark, tmp_path):
    blue, green = (ChunkStore(spark, str(tmp_path / n), 1) for n in ("blue", "green"))
    blue.append(spark.createDataFrame([("b", "", [1.0], "d", "w")], _ROW))
    green.append(spark.createDataFrame([("g", "", [1.0], "d", "w")], _ROW))
    with pytest.raises(ValueError, match="no store"):
        ChunkStore.active(spark, str(tmp_path / "active"))
    for store, want in ((blue, "b"), (green, "g")):
        store.activate(str(tmp_path / "active"))
        assert [r["id"] for r in ChunkStore.active(spark.newSession(), str(tmp_path / "active")).read().collect()] == [want]


def _container(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)


def test_containers_in_reading_order(spark, tmp_path):
    spine = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="x" href="a%20one.xhtml"/><item id="y" href="text/b.xhtml"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>'
    box = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
    pages = {"OEBPS/a one.xhtml": "<p>last</p>", "OEBPS/text/b.xhtml": "<p>first</p>"}
    _container(tmp_path / "a.epub", {"META-INF/container.xml": box, "OEBPS/book.opf": spine, **pages})
    _container(tmp_path / "b.epub", pages)
    slides = {f"ppt/slides/slide{i}.xml": f"<p>s{i}</p>" for i in (1, 2, 10)}
    shown = '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst>' + "".join(f'<p:sldId id="{i}" r:id="r{n}"/>' for i, n in enumerate((10, 1, 2))) + "</p:sldIdLst></p:presentation>"
    rels = "<Relationships>" + "".join(f'<Relationship Id="r{n}" Target="slides/slide{n}.xml"/>' for n in (1, 2, 10)) + "</Relationships>"
    _container(tmp_path / "c.pptx", {"ppt/presentation.xml": shown, "ppt/_rels/presentation.xml.rels": rels, **slides})
    _container(tmp_path / "d.pptx", slides)
    _container(tmp_path / "e.odt", {"content.xml": "<p>whole</p>", "styles.xml": "<p>no</p>"})
    got = {r["path"].rpartition("/")[2]: r["content"] for r in formats.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.epub": "first\nlast", "b.epub": "last\nfirst", "c.pptx": "s10\ns1\ns2", "d.pptx": "s1\ns2\ns10", "e.odt": "whole"}


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE region", "INSERT INTO region SELECT * FROM region", "SHOW TABLES", "SELECT reflect('java.lang.System', 'getenv')", "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
        "SELECT * FROM region WHERE r_name IN (SELECT r_name FROM parquet.`/x`)", "WITH a AS (SELECT java_method('java.lang.System', 'getenv') AS x) SELECT * FROM a", "SELECT * FROM spark_catalog.default.region",
        "SELECT * FROM other", "SELECT (SELECT max(r_name) FROM csv.`/etc/passwd`)", "SELECT * FROM range(5)", "SELECT 1 UNION SELECT try_reflect('java.lang.System', 'getenv')",
    ],
)
def test_sql_refuses(spark, text):
    with pytest.raises(ValueError):
        sql.run_sql(spark, "/root/testdata/sf0.001", text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT count(*) FROM region", 5), ("WITH a AS (SELECT * FROM region) SELECT count(*) FROM a JOIN nation ON n_regionkey = r_regionkey", 25),
        ("SELECT count(*) FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS n FROM region) AS t WHERE n > 1 AND r_name IN (SELECT r_name FROM region)", 4),
        ("SELECT sum(n) FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1 UNION ALL SELECT 1, 1 ORDER BY 1 LIMIT 10) AS t", 26),
    ],
)
def test_sql_runs_queries(spark, text, want):
    assert sql.run_sql(spark, "/root/testdata/sf0.001", text).first()[0] == want


def test_connection_strings():
    parts = sql.parse_connection("postgresql://u:p@h:5432/db?x=1")
    assert parts["user"] == "u" and parts["database"] == "db" and sql.format_connection(parts) == "postgresql://u:p@h:5432/db?x=1"


def test_connectors_need_a_fetcher(spark):
    connectors.register_connectors(spark)
    with pytest.raises(Exception, match="fetcher"):
        spark.read.format("confluence").option("targets", "a").load().collect()


def test_windows_of_a_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    state.run_batches(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    assert sum(seen) == src.count()
    q = state.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == src.count()


class _State:
    """A group's state as the engine hands it over."""

    hasTimedOut, exists, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, ms):
        assert ms == 1704067200000 + state.DAYS_7_MS

    def remove(self):
        self.exists = False


def test_document_status_only_advances():
    import pandas as pd

    s = _State()
    step = lambda *names: next(state._advance(("d",), iter([pd.DataFrame({"status": names, "ts": pd.Timestamp("2024-01-01")})]), s)).iloc[0].tolist()
    assert step("queued", "processing") == ["d", "processing", 2]
    assert step("queued", "nonsense") == ["d", "processing", 4]
    assert step("failed") == ["d", "failed", 5]
    assert step("queued") == ["d", "queued", 6]
    s.hasTimedOut = True
    assert list(state._advance(("d",), iter([]), s)) == [] and not s.exists


def test_status_stream_ends(spark, tmp_path):
    """Everything there is, in two runs over the same checkpoint; the second sees only what came since."""
    folder, data = tmp_path / "out", tmp_path / "in"
    write = lambda rows: spark.createDataFrame(rows, "document_id string, status string, ts timestamp").write.mode("append").parquet(str(data))
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    write([("a", "queued", at(1)), ("a", "completed", at(3)), ("b", "queued", at(1)), ("b", "failed", at(2))])
    stream = spark.readStream.schema("document_id string, status string, ts timestamp").parquet(str(data))
    assert {tuple(r) for r in state.final_status(stream, str(folder)).collect()} == {("a", "completed", 2), ("b", "failed", 2)}
    write([("a", "processing", at(4)), ("b", "queued", at(5)), ("c", "nonsense", at(5))])
    assert {tuple(r) for r in state.final_status(stream, str(folder)).collect()} == {("a", "completed", 3), ("b", "queued", 3), ("c", "pending", 1)}
