"""Files to documents: discovery on the driver, reading and extraction in tasks with errors kept apart."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.functions.text import html_to_text

#: Extensions read as they are, those with a loader of their own, and directories left out.
TEXT = (".md", ".mdx", ".txt", ".rst", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rb", ".java", ".cs", ".php", ".json", ".yaml", ".yml", ".toml", ".css", ".sql", ".sh")
SPECIAL = {".pdf": "pdf", ".docx": "docx", ".html": "html", ".htm": "html", ".csv": "csv"}
SKIPPED = ("node_modules", ".git", ".ragdata", "dist", "build")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def loader_of(path: Column) -> Column:
    """Name of the loader for a path's extension: text, html, csv, docx, pdf, or null."""
    ext = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    special = F.create_map(*(F.lit(x) for pair in SPECIAL.items() for x in pair))
    return F.coalesce(special[ext], F.when(ext.isin(*TEXT), F.lit("text")))


def discover(root: str) -> list[str]:
    """A file itself, whatever its extension, or the loadable files below a directory."""
    if os.path.isfile(root):
        return [root]
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    found = []
    for base, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED and not d.startswith("."))
        found += [os.path.join(base, n) for n in sorted(names) if os.path.splitext(n)[1].lower() in (*TEXT, *SPECIAL)]
    return found


def parse_csv(text: str) -> list[list[str]]:
    """Fields of each record. Quotes open and close anywhere in a field, a doubled one inside is a quote; LF, CRLF and
    CR end a record unless quoted; records of blank fields only go."""
    records: list[list[str]] = []
    fields: list[str] = []
    quoted, i, part = False, 0, io.StringIO()
    stops = '",\r\n'
    while i < len(text):
        j = i
        while j < len(text) and (text[j] != '"' if quoted else text[j] not in stops):
            j += 1
        part.write(text[i:j])
        if j == len(text):
            break
        c = text[j]
        i = j + 1
        if quoted:
            if text[i : i + 1] == '"':
                part.write('"')
                i += 1
            else:
                quoted = False
        elif c == '"':
            quoted = True
        else:
            fields.append(part.getvalue())
            part = io.StringIO()
            if c != ",":
                records.append(fields)
                fields = []
                if c == "\r" and text[i : i + 1] == "\n":
                    i += 1
    if fields or part.getvalue():
        records.append([*fields, part.getvalue()])
    return [r for r in records if any(f.strip() for f in r)]


def csv_documents(source: str, text: str) -> list[tuple[str, str]]:
    """One document per record after the header: `column: value` lines. Missing cells are empty, surplus ones go."""
    records = parse_csv(text)
    if len(records) < 2:
        return []
    header = [h.strip() for h in records[0]]
    return [(f"{source}:row{i + 2}", "\n".join(f"{h}: {(r[j] if j < len(r) else '').strip()}" for j, h in enumerate(header))) for i, r in enumerate(records[1:])]


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word document, with blank lines between."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p")).strip()


def pdf_text(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the pypdf package") from e
    return "\n\n".join((page.extract_text() or "") for page in PdfReader(io.BytesIO(data)).pages).strip()


#: Loaders whose files need Python; more can be registered.
LOADERS: dict[str, Callable[[str, bytes], list[tuple[str, str]]]] = {
    "csv": lambda source, data: csv_documents(source, data.decode("utf-8", "replace")),
    "docx": lambda source, data: [(source, docx_text(data))],
    "pdf": lambda source, data: [(source, pdf_text(data))],
}


def _read(loaders: dict[str, Callable[[str, bytes], list[tuple[str, str]]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, loader, data in zip(batch["path"], batch["loader"], batch["content"], strict=True):
                try:
                    found = loaders[loader](path, bytes(data)) if loader in loaders else [(path, bytes(data).decode("utf-8", "replace"))]
                    out += [(loader, i, s, t, None) for i, (s, t) in enumerate(found)]
                except Exception as e:  # one bad file must not fail the others; it is reported in `error`
                    out.append((loader, 0, path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["loader", "part", "source", "text", "error"])

    return run


def load_files(spark: SparkSession, paths: list[str], root: str | None = None) -> DataFrame:
    """(source, text, error) of the given files, sources relative to `root`. A file that cannot be read is one row with
    an error and no text; files without a loader and empty texts give no row."""
    listed = spark.createDataFrame([(p,) for p in paths], "file string")
    listed = listed.withColumn("loader", loader_of(F.col("file"))).filter("loader is not null")

    def content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, loader in zip(batch["file"], batch["loader"], strict=True):
                name = os.path.relpath(p, root) if root else p
                try:
                    with open(p, "rb") as f:
                        rows.append((name, loader, f.read(), None))
                except OSError as e:
                    rows.append((name, loader, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "loader", "content", "failed"])

    data = listed.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(content, "path string, loader string, content binary, failed string")
    return documents_of(data.filter("failed is null")).unionByName(data.filter("failed is not null").select(F.col("path").alias("source"), F.lit(None).cast("string").alias("text"), F.col("failed").alias("error")))


def documents_of(files: DataFrame) -> DataFrame:
    """(path, loader, content) to (source, text, error); content may also come from Spark's binaryFile reader."""
    read = files.select("path", "loader", "content").mapInPandas(_read(LOADERS), "loader string, part int, source string, text string, error string")
    text = F.when(F.col("loader") == "html", html_to_text(F.col("text"))).otherwise(F.col("text"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("text").isNotNull() & text.isNull(), F.lit("invalid character reference"))
    return read.select("source", text.alias("text"), error.alias("error")).filter("error is not null or length(text) > 0")
