"""Documents, extraction results and rule seeds from files, by Spark's own readers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "doc_id string, page_num int, text string, is_scanned boolean, has_table boolean, image_count int, char_count int, rect_count int, has_grid_lines boolean"
METADATA = "doc_id string, filename string, doc_type string, total_pages int, sector string, sector_confidence double, is_scanned boolean, page_range string, doc_kind string"
FACTS = "doc_id string, sector string, fact_type string, subject string, attribute string, value string, unit string, context string, confidence string, source_page int"
RULES = "standard_name string, clause string, rule_text string, attribute string, operator string, threshold string, unit string, condition string, severity string, sector string"
KINDS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "txt": "txt"}
#: Characters of a page from which it counts as text, of a document's first pages likewise, and how many those are.
SCANNED_PAGE, SCANNED_DOCUMENT, FIRST_PAGES = 80, 400, 5


def list_documents(spark: SparkSession, *folders: str) -> DataFrame:
    """path, doc_id, doc_type of the files in these folders. A suffix that no loader takes raises."""
    files = spark.read.format("binaryFile").load(list(folders)).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.substring_index(name, ".", -1))
    kind = F.raise_error(F.concat(F.lit("Unsupported document type: "), suffix))
    for s, k in KINDS.items():
        kind = F.when(suffix == s, k).otherwise(kind)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), kind.alias("doc_type"))


def _page(doc_id, text, **more) -> dict:
    return {"doc_id": doc_id, "page_num": 0, "text": text, "is_scanned": False, "has_table": False, "image_count": 0, "char_count": len(text), "rect_count": 0, "has_grid_lines": False} | more


def docx_text(data: bytes) -> tuple[str, int]:
    """(paragraphs, then tables with bars between cells and marks around them; number of tables) of a DOCX file."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    said = lambda p: "".join("\t" if x.tag == f"{w}tab" else "\n" if x.tag == f"{w}br" else x.text or "" for x in p.iter() if x.tag in (f"{w}t", f"{w}tab", f"{w}br"))
    parts = [t for p in body.findall(f"{w}p") if (t := said(p)).strip()]
    tables = body.findall(f"{w}tbl")
    for k, table in enumerate(tables, 1):
        rows = [" | ".join("\n".join(said(p) for p in cell.findall(f"{w}p")).strip() for cell in row.findall(f"{w}tc")) for row in table.findall(f"{w}tr")]
        parts.append(f"\n[TABLE {k}]\n" + "\n".join(rows) + "\n[/TABLE]\n")
    return "\n".join(parts), len(tables)


def read_pages(spark: SparkSession, *folders: str, pdf: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """Pages of all documents in these folders. A text file or DOCX file is one page; bytes that are not UTF-8 are replaced.

    pdf gives the pages of a PDF file (text, image_count, rect_count, lines, ...); no reader of PDF comes with this package, so
    without it a PDF file raises. A file is read by one task.
    """
    files = list_documents(spark, *folders).join(spark.read.format("binaryFile").load(list(folders)).select("path", "content"), "path")
    texts = files.where("doc_type = 'txt'").select("doc_id", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    no, zero = F.lit(False), F.lit(0)
    plain = texts.select("doc_id", zero.alias("page_num"), "text", no.alias("is_scanned"), no.alias("has_table"), zero.alias("image_count"), F.length("text").alias("char_count"), zero.alias("rect_count"), no.alias("has_grid_lines"))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for d, kind, data in zip(part["doc_id"], part["doc_type"], part["content"]):
                if kind == "docx":
                    text, tables = docx_text(bytes(data))
                    out.append(_page(d, text, has_table=tables > 0))
                elif pdf is None:
                    raise ValueError(f"no reader for PDF files is given: {d}")
                else:
                    out += pdf_pages(d, pdf(bytes(data)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGE.split(", ")])

    other = files.where("doc_type <> 'txt'").select("doc_id", "doc_type", "content").mapInPandas(scan, PAGE)
    return plain.unionByName(other)


def pdf_pages(doc_id: str, pages: list[dict]) -> list[dict]:
    """Page rows of what a PDF reader returns: text, image_count, rect_count and lines of each page."""
    from dossier import fixed

    words = re.compile(fixed.TABLE_WORDS)
    out = []
    for k, p in enumerate(pages):
        text, rects, lines = p.get("text") or "", p.get("rect_count", 0), p.get("lines", 0)
        out.append(_page(doc_id, text, page_num=k, is_scanned=len(text.strip()) < SCANNED_PAGE, has_table=bool(words.search(text)) or lines > 10 or rects > 6, image_count=p.get("image_count", 0), rect_count=rects, has_grid_lines=lines > 8))
    return out


def documents_of(pages: DataFrame) -> DataFrame:
    """doc_id, total_pages, is_scanned: a document is scanned whose first pages hold few characters."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), (F.sum(F.when(F.col("page_num") < FIRST_PAGES, F.length(F.trim("text"))).otherwise(0)) < SCANNED_DOCUMENT).alias("is_scanned"))


def _json(spark: SparkSession, folder: str, name: str, schema: str | None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    if schema is None:
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=True)
    return reader.schema(schema).json(folder)


def read_extraction(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """metadata, facts, rules and tables of processed documents (<folder>/<doc_id>/*.json). Missing files are empty tables, missing fields null.

    tables: doc_id, page, row_index, row map, from objects that hold the rows of each page.
    """
    doc_id = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    read = lambda name, schema: _json(spark, folder, name, schema)
    out = {"metadata": read("metadata.json", METADATA), "facts": read("facts_raw.json", FACTS), "rules": read("rules_raw.json", RULES)}
    raw = read("tables_raw.json", None).select(doc_id.alias("doc_id"), F.from_json("value", "map<string,array<map<string,string>>>").alias("t"))
    pages = raw.select("doc_id", F.explode("t").alias("page", "rows"))
    out["tables"] = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.posexplode("rows").alias("row_index", "row"))
    return out


def seed_rules(seeds: DataFrame) -> DataFrame:
    """Rules from seeds (raw JSON: a list of standards with their sector and rules); clause and the other fields may be missing."""
    kind = "array<struct<standard_name: string, sector: string, rules: array<struct<clause: string, rule_text: string, attribute: string, operator: string, threshold: string, unit: string, condition: string, severity: string>>>>"
    each = seeds.select(F.explode(F.from_json("raw", kind)).alias("s")).select("s.standard_name", "s.sector", F.explode("s.rules").alias("r"))
    return each.select("standard_name", "sector", "r.*")


def read_seed_rules(spark: SparkSession, path: str) -> DataFrame:
    """seed_rules of JSON files; YAML files are converted where a YAML library is there."""
    raw = spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")
    if not path.endswith((".yaml", ".yml")):
        return seed_rules(raw)
    import json

    import yaml

    @F.pandas_udf("string")
    def as_json(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(yaml.safe_load(t)))

    return seed_rules(raw.select(as_json("raw").alias("raw")))


def find_file(spark: SparkSession, name: str, *folders: str) -> str | None:
    """The path of the file of this name in the first of the folders that has it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(conf).exists(path):
            return path.toString()
    return None
