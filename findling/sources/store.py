"""The table of chunks: one logical table in versions, a partition for each workspace."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("document_id", T.StringType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("layer_id", T.StringType()),
    T.StructField("access_roles", T.ArrayType(T.StringType())),
    T.StructField("visibility", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("created_at", T.StringType()),
])


def validate(df: DataFrame, expected: T.StructType = CHUNK) -> None:
    """Names and types must be as expected; extra columns are an error too."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    if have != want:
        raise ValueError(f"schema differs: {sorted(set(have.items()) ^ set(want.items()))}")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Missing columns of a chunk filled in."""
    values = {"layer_id": F.lit("default"), "access_roles": F.array().cast("array<string>"), "visibility": F.lit("private"), "metadata": F.lit("{}")}
    have = set(rows.columns)
    cols = [F.coalesce(F.col(f.name), values[f.name]) if f.name in have and f.name in values else F.col(f.name) if f.name in have else values.get(f.name, F.lit(None)) for f in CHUNK]
    return rows.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cols, CHUNK, strict=True)])


def migrate_v1(rows: DataFrame, layer: str = "default") -> DataFrame:
    """Rows without access columns get them."""
    return rows.withColumns({"layer_id": F.lit(layer), "access_permissions": F.array().cast("array<string>"), "visibility": F.lit("private"), "version": F.lit("v2")})


class ChunkStore:
    """A table under ``path``, local or in an object store, whose every change makes a new version.

    Rows lie in ``data/part_id=.../workspace_id=...``; a written part never changes. The file ``current`` names the parts of
    the version in force and, for each, the workspaces that later parts replaced. It is replaced by one rename when all rows are written, so a
    reader sees a whole version, keeps it as long as it likes, and a write that fails leaves nothing to see. One writer at a time.
    ``vacuum`` deletes what no version in force needs. ``options`` are settings of the file system, such as an
    object store's ``fs.s3a.endpoint``.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int, options: dict[str, str] | None = None):
        self.spark, self.dimension, self.options = spark, dimension, dict(options or {})
        self.path = path.rstrip("/").replace("s3://", "s3a://", 1)

    def version(self) -> dict:
        """``parts`` (name, replaced workspaces) in force and the last number of each stream in ``batches``."""
        text = _read_file(self.spark, f"{self.path}/current", self.options)
        return json.loads(text) if text else {"parts": [], "batches": {}}

    def read(self, version: dict | None = None) -> DataFrame:
        """The version in force now, or one that :meth:`version` gave before."""
        parts = (version or self.version())["parts"]
        names = [f.name for f in CHUNK]
        if not parts:
            return self.spark.createDataFrame([], CHUNK)
        stored = self.spark.read.options(**self.options).option("basePath", f"{self.path}/data")
        rows = stored.schema(T.StructType([*CHUNK, T.StructField("part_id", T.StringType())])).parquet(*[f"{self.path}/data/part_id={p['name']}" for p in parts])
        for p in parts:
            if p["replaced"]:
                rows = rows.filter((F.col("part_id") != p["name"]) | ~F.coalesce(F.col("workspace_id").isin(p["replaced"]), F.lit(False)))
        return rows.select(*names)

    def append(self, rows: DataFrame, files: int | None = None, batch: tuple[str, int] | None = None) -> None:
        """Append chunks; ragged vectors are an error. ``files`` compacts what is written; a ``batch``, a stream's name and a number that rises, is appended once only."""
        now = self.version()
        if batch is not None and batch[1] <= now["batches"].get(batch[0], -1):
            return
        part = self._write(rows, files)
        self._publish([*now["parts"], part], {**now["batches"], **(dict([batch]) if batch is not None else {})})

    def compact(self, files: int | None = None) -> None:
        """A version of one part with the same rows."""
        now = self.version()
        self._publish([self._write(self.read(now), files)], now["batches"])

    def _write(self, rows: DataFrame, files: int | None = None) -> dict:
        rows = with_defaults(rows)
        sized = F.when(F.size("embedding") == self.dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors must have {self.dimension} numbers")))
        rows = rows.withColumn("embedding", F.when(F.col("embedding").isNotNull(), sized))
        name = uuid.uuid4().hex
        out = (rows.repartition(files, "workspace_id") if files else rows).write.options(**self.options)
        out.partitionBy("workspace_id").parquet(f"{self.path}/data/part_id={name}")
        return {"name": name, "replaced": []}

    def _publish(self, parts: list[dict], batches: dict[str, int]) -> None:
        _replace_file(self.spark, f"{self.path}/current", json.dumps({"parts": parts, "batches": batches}), self.options)

    def _replace(self, workspace: str, rows: DataFrame | None) -> None:
        """A version in which ``workspace`` has only ``rows``, read from the version in force."""
        now = self.version()
        older = [{"name": p["name"], "replaced": sorted({*p["replaced"], workspace})} for p in now["parts"]]
        self._publish([*older, *([] if rows is None else [self._write(rows)])], now["batches"])

    def delete(self, workspace: str, ids: DataFrame, key: str = "id") -> int:
        """Remove chunks by identifier or document; the number removed."""
        own = self.read().filter(F.col("workspace_id") == workspace)
        gone = own.join(ids.select(key), key, "left_semi").count()
        if gone:
            self._replace(workspace, own.join(ids.select(key), key, "left_anti").select(*[f.name for f in CHUNK]))
        return gone

    def update(self, workspace: str, patches: DataFrame, cols: tuple[str, ...] = ("content", "embedding")) -> None:
        from findling.operators.tables import patched

        own = self.read().filter(F.col("workspace_id") == workspace)
        self._replace(workspace, patched(own, patches, "id", cols).select(*[f.name for f in CHUNK]))

    def drop(self, workspace: str) -> None:
        self._replace(workspace, None)

    def vacuum(self) -> int:
        """Delete parts that the version in force doesn't name; readers of older versions must be done. The number deleted."""
        live = {f"part_id={p['name']}" for p in self.version()["parts"]}
        fs, data = _file_system(self.spark, f"{self.path}/data", self.options)
        dead = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName().startswith("part_id=") and s.getPath().getName() not in live]
        for path in dead:
            fs.delete(path, True)
        return len(dead)

    def activate(self, pointer: str) -> None:
        """Let the file ``pointer`` name this store: the swap between two tables, for every session that opens it by :meth:`active`."""
        _replace_file(self.spark, pointer, json.dumps({"path": self.path, "dimension": self.dimension}), self.options)

    @classmethod
    def active(cls, spark: SparkSession, pointer: str, options: dict[str, str] | None = None) -> ChunkStore:
        """The store that ``pointer`` names now."""
        text = _read_file(spark, pointer, options or {})
        if text is None:
            raise ValueError(f"{pointer} names no store yet")
        named = json.loads(text)
        return cls(spark, named["path"], named["dimension"], options)


def _file_system(spark: SparkSession, path: str, options: dict[str, str]):
    """The file system of ``path`` and the path in it."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    return target.getFileSystem(_settings(spark, options)), target


def _settings(spark: SparkSession, options: dict[str, str]):
    conf = spark.sparkContext._jvm.org.apache.hadoop.conf.Configuration(spark.sparkContext._jsc.hadoopConfiguration())
    for name, value in options.items():
        conf.set(name, value)
    return conf


def _read_file(spark: SparkSession, path: str, options: dict[str, str]) -> str | None:
    fs, target = _file_system(spark, path, options)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _replace_file(spark: SparkSession, path: str, text: str, options: dict[str, str]) -> None:
    """Write beside ``path`` and rename over it, so readers see the old content or the new."""
    fs, target = _file_system(spark, path, options)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), _settings(spark, options)).rename(beside, target, how)
