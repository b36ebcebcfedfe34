"""Connectors to outside systems, as data sources that need a client.

Each connector is a Python data source: ``spark.dataSource.register(Connector)`` makes it readable
by its name. Fetching needs the network, so the fetcher is passed in as ``module:function``; it
yields (id, title, content, source, published) for its options.
"""

from __future__ import annotations

import importlib

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, title string, content string, source string, published string"
NAMES = ("youtube_transcript", "confluence", "repository", "drupal_wiki", "obsidian_vault", "paperless")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(t) for t in self.options.get("targets", "").split(",") if t]

    def read(self, partition):
        if "fetcher" not in self.options:
            raise ValueError("this connector needs option fetcher=module:function")
        module, _, name = self.options["fetcher"].partition(":")
        for row in getattr(importlib.import_module(module), name)(partition.value, dict(self.options)):
            yield tuple(row)


def _connector(kind: str) -> type[DataSource]:
    class Connector(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema):
            return _Reader(self.options)

    Connector.__name__ = kind
    return Connector


def register_connectors(spark: SparkSession) -> None:
    for kind in NAMES:
        spark.dataSource.register(_connector(kind))
