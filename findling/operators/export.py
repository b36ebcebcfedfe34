"""Chats in exchange formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.operators.text import csv_field


def csv_lines(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``line``: every value quoted."""
    return rows.withColumn("line", F.concat_ws(",", *[csv_field(F.col(c).cast("string")) for c in cols]))


def _answer():
    return F.get_json_object("response", "$.text")


def alpaca(chats: DataFrame, default_system: str) -> DataFrame:
    return chats.withColumns({"instruction": F.coalesce("system", F.lit(default_system)), "input": F.col("prompt"), "output": _answer()})


def jsonl(chats: DataFrame, default_system: str) -> DataFrame:
    """(workspace_id, line): the messages of a workspace in order of their ids, images of attachments after the prompt."""
    content = lambda c: F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("string").alias("image")))
    files = F.from_json(F.get_json_object("response", "$.attachments"), "array<struct<contentString:string>>")
    images = F.transform(F.coalesce(files, F.array().cast("array<struct<contentString:string>>")), lambda a: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), a["contentString"].alias("image")))
    pair = F.array(F.struct(F.lit("user").alias("role"), F.concat(content(F.col("prompt")), images).alias("content")), F.struct(F.lit("assistant").alias("role"), content(_answer()).alias("content")))
    grouped = chats.groupBy("workspace_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id"), pair.alias("pair")))).alias("m"), F.min_by("system", "id").alias("system"))
    head = F.array(F.struct(F.lit("system").alias("role"), content(F.coalesce("system", F.lit(default_system))).alias("content")))
    messages = F.concat(head, F.flatten(F.transform("m", lambda x: x["pair"])))
    return grouped.select("workspace_id", F.to_json(F.struct(messages.alias("messages"))).alias("line"))


def write_chats(chats: DataFrame, path: str, form: str, default_system: str = "") -> None:
    """Write chats as ``csv``, ``json``, ``jsonl`` or ``alpaca`` files."""
    if form == "csv":
        chats.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    elif form == "json":
        chats.write.json(path)
    elif form == "jsonl":
        jsonl(chats, default_system).select("line").write.text(path)
    elif form == "alpaca":
        alpaca(chats, default_system).select("instruction", "input", "output").write.json(path)
    else:
        raise ValueError(f"unknown export format {form}")
