"""From files and pages to documents."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import mailbox
import posixpath
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.session import ship

#: Extensions by parser; what isn't listed fails.
PARSERS = {
    "pdf": "pdf", "docx": "docx", "txt": "text", "md": "text", "log": "text", "html": "html", "htm": "html",
    "csv": "csv", "json": "json", "mbox": "mbox", "xlsx": "xlsx", "epub": "epub", "odt": "office", "odp": "office", "pptx": "office",
}
_MIMES = {"application/pdf": "pdf", "text/html": "html", "text/plain": "txt", "text/markdown": "txt", "text/csv": "csv", "application/json": "json", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx"}


def detect(mime: Column, name: Column, head: Column) -> Column:
    """Format by MIME type, then by extension, then by the first characters."""
    kind = F.trim(F.split(F.lower(mime), ";")[0])
    by_mime = F.element_at(F.create_map(*[F.lit(x) for kv in _MIMES.items() for x in kv]), kind)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    names = {"htm": "html", "md": "txt", "log": "txt"}
    by_name = F.when(ext.isin(*PARSERS), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), ext), ext))
    start = F.ltrim(head)
    by_head = (
        F.when(F.startswith(head, F.lit("%PDF")), "pdf").when(F.startswith(head, F.lit("PK\x03\x04")), "docx").when(F.startswith(start, F.lit("<")), "html").when(F.startswith(start, F.lit("{")) | F.startswith(start, F.lit("[")), "json").otherwise("txt")
    )
    return F.coalesce(by_mime, by_name, by_head)


def dispatch(files: DataFrame, name_col: str) -> DataFrame:
    """``parser`` and ``success`` by extension; unknown extensions fail."""
    ext = F.lower(F.regexp_extract(name_col, r"\.([A-Za-z0-9]+)$", 1))
    parser = F.element_at(F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv]), ext)
    return files.withColumn("parser", parser).withColumn("success", F.col("parser").isNotNull())


def joined_rows(rows: DataFrame, by: str = " | ") -> DataFrame:
    """``line``: the values of each row, nulls as empty."""
    return rows.withColumn("line", F.concat_ws(by, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]))


def links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``link``: each href of each page."""
    return pages.withColumn("link", F.explode(F.regexp_extract_all(html_col, F.lit('href="([^"]*)"'), F.lit(1))))


def decode(content: bytes) -> str:
    """UTF-8, then UTF-16 where a mark says so, else Latin-1."""
    for encoding in ("utf-8", "utf-16"):
        if encoding == "utf-16" and content[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def _tags(xml: bytes, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in ElementTree.fromstring(xml).iter() if e.tag.rpartition("}")[2] == name)


def _text(element: ElementTree.Element) -> str:
    return "".join(e.text or "" for e in element.iter() if e.tag.rpartition("}")[2] == "t")


def _docx(content: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(_tags(z.read("word/document.xml"), "body"))
    lines, rows = [], []
    for e in body:
        tag = e.tag.rpartition("}")[2]
        if tag == "p" and (t := _text(e)).strip():
            lines.append(t)
        elif tag == "tbl":
            for r in (x for x in e.iter() if x.tag.rpartition("}")[2] == "tr"):
                rows.append(" | ".join(_text(c).strip() for c in r if c.tag.rpartition("}")[2] == "tc"))
    return [("", "\n\n".join(lines + rows))]


def _html(content: bytes) -> list[tuple[str, str]]:
    text = content.decode("utf-8", errors="replace")
    text = re.sub(r"(?s)<(script|style)[^>]*>.*?</\1>", "", text)
    return [("", re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip())]


def _csv(content: bytes) -> list[tuple[str, str]]:
    return [("", "\n".join(" | ".join(r) for r in csv.reader(io.StringIO(decode(content)))))]


def _json(content: bytes) -> list[tuple[str, str]]:
    text = decode(content)
    try:
        return [("", json.dumps(json.loads(text), indent=2, ensure_ascii=False))]
    except ValueError:
        return [("", text)]


def _mbox(content: bytes) -> list[tuple[str, str]]:
    with tempfile.NamedTemporaryFile(suffix=".mbox") as f:
        f.write(content)
        f.flush()
        out = []
        for m in mailbox.mbox(f.name, factory=lambda b: email.message_from_binary_file(b, policy=email.policy.default)):
            body = ""
            for part in m.walk():
                if part.get_content_type() in ("text/plain", "text/html"):
                    got = part.get_content()
                    body = _html(got.encode())[0][1] if part.get_content_type() == "text/html" else got
            out.append((str(m["subject"] or ""), body.strip()))
        return [x for x in out if x[1]]


def _xlsx(content: bytes) -> list[tuple[str, str]]:
    """A CSV document for each sheet with values; quotes only where a string holds a comma."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_text(e) for e in _tags(z.read("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        titles = [e.get("name") or "" for e in _tags(z.read("xl/workbook.xml"), "sheet")]
        out = []
        for title, name in zip(titles, sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), strict=False):
            lines = []
            for row in _tags(z.read(name), "row"):
                cells = []
                for c in (x for x in row if x.tag.rpartition("}")[2] == "c"):
                    v = next((x.text or "" for x in c if x.tag.rpartition("}")[2] == "v"), _text(c))
                    v = shared[int(v)] if c.get("t") == "s" and v else v
                    cells.append(f'"{v}"' if "," in v and c.get("t") in ("s", "str", "inlineStr") else v)
                lines.append(",".join(cells))
            if any(x.strip(",") for x in lines):
                out.append((title, "\n".join(lines)))
        return out


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Members of a container by the identifier that ``part`` refers to them with."""
    folder, name = posixpath.split(part)
    rels = ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") for r in rels}


def _spine(z: zipfile.ZipFile) -> list[str]:
    """Members of a book in reading order: container, package, the spine's items through the manifest."""
    package = ElementTree.fromstring(z.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
    book = ElementTree.fromstring(z.read(package))
    items = {i.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(i.get("href")))) for i in book.iterfind(".//{*}manifest/{*}item")}
    return [items[i.get("idref")] for i in book.iterfind(".//{*}spine/{*}itemref")]


def _slides(z: zipfile.ZipFile) -> list[str]:
    """Slides in the order of the presentation; other office files have one content."""
    if "content.xml" in z.namelist():
        return ["content.xml"]
    part = "ppt/presentation.xml"
    by_id = _targets(z, part)
    shown = ElementTree.fromstring(z.read(part)).iterfind(".//{*}sldIdLst/{*}sldId")
    return [by_id[value] for s in shown for key, value in s.attrib.items() if key.endswith("}id")]


def _natural(name: str) -> list[tuple[int, str]]:
    """A key that puts slide2 before slide10."""
    return [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"([0-9]+)", name)]


def _zipped_text(order: Callable[[zipfile.ZipFile], list[str]], pattern: str) -> Callable[[bytes], list[tuple[str, str]]]:
    """Text of the members that ``order`` names; where a container's own order can't be read, of those like ``pattern``, by number."""

    def read(content: bytes) -> list[tuple[str, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            held = set(z.namelist())
            try:
                names = [n for n in order(z) if n in held]
            except (KeyError, AttributeError, TypeError, ElementTree.ParseError):
                names = []
            names = names or sorted((n for n in held if re.search(pattern, n)), key=_natural)
            return [("", "\n".join(t for n in names if (t := _html(z.read(n))[0][1])))]

    return read


def _pdf(content: bytes) -> list[tuple[str, str]]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF library is installed") from e
    return [("", "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages))]


READERS: dict[str, Callable[[bytes], list[tuple[str, str]]]] = {
    "text": lambda c: [("", decode(c))], "html": _html, "csv": _csv, "json": _json, "docx": _docx, "mbox": _mbox, "xlsx": _xlsx, "pdf": _pdf,
    "epub": _zipped_text(_spine, r"\.x?html?$"), "office": _zipped_text(_slides, r"(content|slides/slide\d+)\.xml$"),
}
DOCUMENT = "path string, part int, title string, content string, char_count int, word_count int, error string"


def read_documents(spark: SparkSession, path: str, readers: dict | None = None) -> DataFrame:
    """A row for each document in the files under ``path``; a file that can't be read gives a row with ``error``."""
    ship(spark)
    use = {**READERS, **(readers or {})}

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                parser = PARSERS.get(name.rpartition(".")[2].lower())
                try:
                    if parser is None:
                        raise ValueError("unsupported extension")
                    for i, (title, text) in enumerate(use[parser](bytes(content))):
                        out.append((name, i, title, text, len(text), len(text.split()), None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the job; its row says why
                    out.append((name, 0, None, None, 0, 0, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "part", "title", "content", "char_count", "word_count", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, DOCUMENT)


def walk_repository(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a source tree without dependency folders and without files that hold secrets."""
    from findling.operators.governance import without_secrets

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(~F.rlike("path", F.lit(r"/(\.git|node_modules|venv)/")))
    text = files.select("path", F.decode("content", "UTF-8").alias("text"))
    return without_secrets(text)
