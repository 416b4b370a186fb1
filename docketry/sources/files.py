"""Sources: JSON lines, term lists, key words, whole texts, directories, HTML, office documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.text import strip
from docketry.operators.retrieval import compiles

MIME = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "html": "text/html", "htm": "text/html", "txt": "text/plain",
        "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct terms of a list's first column without comments, longest first."""
    first = strip(F.regexp_replace(F.split("value", ",")[0], "^﻿", ""))
    terms = spark.read.text(path).select(first.alias("term")).where("term <> '' and not startswith(term, '#')").distinct()
    return terms.orderBy(F.length("term").desc(), "term")


def keyword_table(spark: SparkSession, path: str) -> DataFrame:
    """(tag, pattern): key words of tags but 其他; those that are no valid pattern are taken literally.

    A dictionary of a few hundred rows: patterns are tried once, on the driver, by the engine that will run them.
    """
    read = spark.read.option("header", "true").csv(path).where("trim(keyword) <> '' and risk_tag <> '其他'").select("risk_tag", "keyword").distinct()
    words = [(r.risk_tag, r.keyword if compiles(r.keyword) else "\\Q" + r.keyword + "\\E") for r in sorted(read.collect())]
    return spark.createDataFrame(words, "tag string, pattern string")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def directory(spark: SparkSession, path: str, prefer_pdf: bool = True) -> DataFrame:
    """Files of known kinds below a folder; of files with the same stem the PDF, if preferred."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("file_name", name).withColumn("ext", F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))).where(F.col("ext").isin(*MIME))
    if not prefer_pdf:
        return files.orderBy("path")
    stem = F.lower(F.regexp_replace("file_name", r"\.[^.]+$", ""))
    rank = F.row_number().over(Window.partitionBy(stem).orderBy((F.col("ext") == "pdf").desc(), "path"))
    return files.withColumn("_rank", rank).where("_rank = 1").drop("_rank").orderBy("path")


def mime_of(file_name: Column) -> Column:
    ext = F.lower(F.regexp_extract(file_name, r"\.([^.]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ext)


def html_text(html: Column) -> Column:
    """Lines of a page without scripts, styles, navigation and footers, joined by line breaks."""
    kept = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>", "")
    lines = F.split(F.regexp_replace(kept, r"(?s)<[^>]*>", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n")


def html_tables(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)(<table\b.*?</table\s*>)"), F.lit(1))


def _paragraphs(element: ElementTree.Element) -> list[str]:
    return ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in element.iter() if p.tag.endswith("}p")]


def office_text(content: bytes) -> str:
    """Paragraphs of a DOCX, or the slides of a PPTX that hold text, each under its number with its shapes' lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if "word/document.xml" in names:
            texts = [t.strip() for t in _paragraphs(ElementTree.fromstring(z.read("word/document.xml")))]
            return "\n\n".join(t for t in texts if t)
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for i, name in enumerate(slides, 1):
            shapes = [s for s in ElementTree.fromstring(z.read(name)).iter() if s.tag.endswith("}sp")]
            texts = [t for t in ("\n".join(_paragraphs(s)) for s in shapes) if t.strip()]
            if texts:
                out.append(f"## 第{i}页\n" + "\n".join(texts))
        return "\n\n".join(out)


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, confidence, error) of DOCX and PPTX files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    text, error = office_text(bytes(content)), None
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as x:
                    text, error = "", str(x)
                rows.append((p, text, 0.9 if text else 0.0, error))
            yield pd.DataFrame(rows, columns=["path", "text", "confidence", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,pptx}").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string, confidence double, error string")


def best_attempt(*attempts: Column, threshold: float = 0.5) -> Column:
    """The first parse attempt (struct with confidence) that reaches the threshold, else the last that is not null."""
    tried = [F.when(a["confidence"] >= threshold, a) for a in attempts]
    return F.coalesce(*tried, *reversed(attempts))
