"""Binary files as a source: intake rules and distributed extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexframe.functions.text import trim
from codexframe.sources.extract import CHAPTER_LABEL, EXTRACTORS, ExtractionError, extract, html_section

# fixed values: accepted kinds, most bytes, fewest characters
KINDS, MOST_BYTES, LEAST_CHARS = ("pdf", "pptx", "docx", "epub"), 25 * 1024 * 1024, 20
SECTIONS = "array<struct<text:string,page_number:int,source_label:string>>"


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``path, modificationTime, length, content`` of the files under a path."""
    if stream:
        kind = "path string, modificationTime timestamp, length long, content binary"
        return spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").load(path)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def file_kind(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def title_of(path: Column) -> Column:
    """File name without its extension, or the whole name if nothing is left."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    bare = trim(F.regexp_replace(name, r"\.[^.]+$", ""))
    return F.when(bare != "", bare).otherwise(name)


def intake(files: DataFrame) -> DataFrame:
    """``file_type, title`` and ``reject`` (null if accepted): unsupported type, empty or too large."""
    kind = file_kind(F.col("path"))
    reject = (
        F.when(~kind.isin(*KINDS), "unsupported type").when(F.col("length") <= 0, "empty file").when(F.col("length") > MOST_BYTES, "too large")
    )
    return files.withColumn("file_type", kind).withColumn("title", title_of(F.col("path"))).withColumn("reject", reject)


def extract_files(accepted: DataFrame, id_col: str = "path") -> DataFrame:
    """``id, sections, text, error``: one row per file. A file fails alone, with its reason; so does one
    with fewer than 20 characters of text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, kind, content in zip(frame["id"], frame["kind"], frame["content"]):
                try:
                    found = extract(bytes(content), kind)
                    text = "\n\n".join(s[0] for s in found)
                    error = None if len(text) >= LEAST_CHARS else "too little text"
                    rows.append((key, [dict(zip(("text", "page_number", "source_label"), s)) for s in found], text, error))
                except ExtractionError as problem:
                    rows.append((key, [], None, str(problem)[:500]))
            yield pd.DataFrame(rows, columns=["id", "sections", "text", "error"])

    given = accepted.select(F.col(id_col).cast("string").alias("id"), F.col("file_type").alias("kind"), "content")
    return given.mapInPandas(run, f"id string, sections {SECTIONS}, text string, error string")


def extract_html(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id, source_label, text`` of web pages, each as the first chapter of its own book; empty ones go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, html_section(html or "", 1)) for key, html in zip(frame["id"], frame["html"])]
            yield pd.DataFrame([(k, s[2], s[0]) for k, s in rows if s], columns=["id", "source_label", "text"])

    given = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return given.mapInPandas(run, f"id {dict(given.dtypes)['id']}, source_label string, text string")


__all__ = ["CHAPTER_LABEL", "EXTRACTORS", "extract_files", "extract_html", "file_kind", "intake", "read_files", "title_of"]
