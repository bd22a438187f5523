"""Page classification and page filters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import fixed
from dossier.functions import expr as E

_SPACES = " \t\n\x0b\f\r"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


#: Words one of which a text must hold, in small letters, for a pattern to be found in it. Looking for them costs a fraction of the pattern.
_NEEDS = dict(zip((*fixed.TABLE_PATTERNS, *fixed.IMAGE_PATTERNS, *fixed.ENGINEERING_PATTERNS), (
    ("|",), ("\t",), ("sr",), ("no",), (".", ")"), ("|", ":"), ("sl",), ("description",),
    ("fig",), ("drawing", "plan", "section", "elevation", "layout"), ("plate",), ("scale", "n.t.s."), ("legend",),
    ("m", "k", "rpm"), ("design", "proposed", "existing", "required", "minimum", "maximum"), ("grade", "class", "type", "category"), ("irc", "is", "rdso", "dmrc", "mmrda"),
    ("bearing capacity", "shear strength", "compressive strength", "tensile"), ("viaduct", "tunnel", "station", "depot", "alignment", "corridor", "platform"),
)))


def _guarded_hits(text: Column, low: Column, patterns: Iterable[str]) -> Column:
    """E.hits(text, patterns), each pattern searched for only where its words are; low is text in small letters."""
    out = F.lit(0)
    for p in patterns:
        there = reduce(lambda a, b: a | b, [low.contains(w) for w in _NEEDS[p]])
        out = out + F.when(there, text.rlike(p).cast("int")).otherwise(0)
    return out


def classify_pages(pages: DataFrame) -> DataFrame:
    """page_num, category, table_score, image_score: one chain of rules, first match decides."""
    text = F.coalesce("text", F.lit(""))
    p = pages.withColumn("_t", text).withColumn("_n", F.length(_strip(F.col("_t")))).withColumn("_low", F.lower("_t"))
    p = p.withColumn("_lines", F.filter(F.transform(F.split("_t", "\n"), _strip), lambda x: x != ""))
    # a line of a table of contents ends in a digit
    toc = F.coalesce(F.try_divide(F.size(F.filter("_lines", lambda x: F.substring(x, -1, 1).between("0", "9") & x.rlike(fixed.TOC_LINE))), F.size("_lines")), F.lit(0.0))
    r, t = F.col("rect_count"), F.col("_t")
    table = F.least(F.lit(1.0), F.when(r > 50, 0.5).when(r > 20, 0.35).when(r > 6, 0.2).otherwise(0.0) + F.when(F.col("has_grid_lines"), 0.3).otherwise(0.0) + F.least(F.lit(0.3), _guarded_hits(t, F.col("_low"), fixed.TABLE_PATTERNS) * 0.08))
    images = F.col("image_count")
    image = F.least(F.lit(1.0), F.least(F.lit(0.5), images * 0.2) + F.when((F.col("_n") < 100) & (images > 0), 0.4).otherwise(0.0) + F.least(F.lit(0.2), _guarded_hits(t, F.col("_low"), fixed.IMAGE_PATTERNS) * 0.1))
    # Patterns that only decide about short or table-like pages are not searched for in others.
    short = lambda limit, patterns: F.when(F.col("_n") < limit, E.hits(t, patterns)).otherwise(0)
    p = p.withColumns({"table_score": table, "image_score": image, "_toc": toc, "_h": short(200, fixed.HEADER_PATTERNS), "_a": short(500, fixed.ADMIN_PATTERNS)})
    p = p.withColumn("_e", F.when(F.col("table_score") > 0.3, _guarded_hits(t, F.col("_low"), fixed.ENGINEERING_PATTERNS) / len(fixed.ENGINEERING_PATTERNS)).otherwise(0.0))
    n, e, ts = F.col("_n"), F.col("_e"), F.col("table_score")
    category = (
        F.when(n < 30, "SKIP").when(F.col("_toc") > 0.5, "SKIP").when((F.col("_h") > 0) & (n < 200), "SKIP").when((F.col("_a") >= 2) & (n < 500), "SKIP")
        .when((F.col("image_score") > 0.6) & (n < 150), "IMAGE").when((ts > 0.6) & (e < 0.2), "TABLE").when((ts > 0.3) & ((e > 0.2) | (n > 300)), "MIXED").otherwise("TEXT")
    )
    return p.select("page_num", category.alias("category"), F.round("table_score", 6).alias("table_score"), F.round("image_score", 6).alias("image_score"))


def route_pages(pages: DataFrame) -> DataFrame:
    """page_num, category, reads_facts, reads_tables: what is read of each page. Pages of images and skipped pages give nothing."""
    c = classify_pages(pages).join(extractable(pages).select("page_num", F.lit(True).alias("has_content")), "page_num", "left")
    kind = F.col("category")
    return c.select("page_num", "category", (kind.isin("TEXT", "MIXED") & F.coalesce("has_content", F.lit(False))).alias("reads_facts"), kind.isin("TABLE", "MIXED").alias("reads_tables"))


def likely_tables(pages: DataFrame) -> DataFrame:
    """Pages with words of tables, more than ten lines drawn or more than six boxes."""
    return pages.where(F.coalesce("text", F.lit("")).rlike(fixed.TABLE_WORDS) | (F.col("line_count") > 10) | (F.col("rect_count") > 6))


def simple_pages(pages: DataFrame) -> DataFrame:
    """Short pages with fewer than three measures, which a small model may read."""
    t = F.coalesce("text", F.lit(""))
    return pages.where((t == "") | ((F.length(_strip(t)) <= 600) & (F.size(F.regexp_extract_all(t, F.lit(f"({fixed.MEASURES})"), 1)) < 3)))


def pages_between(pages: DataFrame, start: int = fixed.REPORT_START, most: int | None = None) -> DataFrame:
    """Pages from the start-th on, at most so many; page_num counts from 0."""
    first = max(0, start - 1)
    here = pages.where(F.col("page_num") >= first)
    return here.where(F.col("page_num") < first + most) if most else here


def texts_for(pages: DataFrame, least: int) -> DataFrame:
    """Pages that say enough: more than LEAST_GRAPH_TEXT characters for triples, at least LEAST_FACT_TEXT for facts, LEAST_RULE_TEXT for rules."""
    return pages.where(F.length(_strip(F.coalesce("text", F.lit("")))) >= least)


def extractable(pages: DataFrame) -> DataFrame:
    """Pages with 80 characters, a digit and three lines that are not blank."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: _strip(x) != "")
    return pages.where((F.length(_strip(t)) >= 80) & t.rlike("[0-9]") & (F.size(lines) >= 3))


def chunks_of(text: str | None, size: int, overlap: int) -> list[str]:
    """Pieces of about size characters on word boundaries; each repeats up to overlap characters of the last."""
    if not text:
        return []
    if len(text) <= size:
        return [text]
    out: list[str] = []
    words, length = [], 0
    for w in text.split():
        if words and length + len(w) + 1 > size:
            out.append(" ".join(words))
            back = len(words)
            length = 0
            while back and length + len(words[back - 1]) + 1 <= overlap:
                back -= 1
                length += len(words[back]) + 1
            words = words[back:]
        words.append(w)
        length += len(w) + 1
    return out + ([" ".join(words)] if words else [])


def chunk_pages(pages: DataFrame, size: int = 5000, overlap: int = 150) -> DataFrame:
    """page_num, chunk, text. What a piece repeats hangs on the pieces before it, so this runs on Arrow batches."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, k, c) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, c in enumerate(chunks_of(t, size, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int32(), pa.string()))], ["page_num", "chunk", "text"])

    return pages.select("page_num", "text").mapInArrow(scan, "page_num long, chunk int, text string")
