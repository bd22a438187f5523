"""Where a model may be plugged in: functions on texts, images and rows, applied in batches on the executors.

A hook gets plain Python values and returns rows; without one, the tables it would fill are empty. What hooks
return is checked and completed here, so that what follows is the same with any model.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier import fixed

#: Kinds of work and the size of model that does them.
ROUTES = {"extraction": "large", "concept": "small", "classify": "small", "consistency": "large", "validation": "large"}


def route(task: str, models: dict[str, str]) -> str:
    """The model of a kind of work; unknown kinds go to the large one."""
    return models[ROUTES.get(task, "large")]


def retried(call: Callable, attempts: int = 3, least: float = 2.0, most: float = 10.0, wait: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again after 1, 2, 4 ... seconds within these bounds; the last failure is raised."""

    def tried(*args, **kw):
        for k in range(attempts):
            try:
                return call(*args, **kw)
            except Exception:
                if k == attempts - 1:
                    raise
                wait(min(most, max(least, 2.0**k)))

    return tried


def parse_answer(raw: str | None):
    """The JSON value in a model's answer: without fences, whole; else its first array; else all objects in it, in a list; else None."""
    text = re.sub(r"(?m)^```(?:json)?\s*|\s*```$", "", raw or "").strip()
    try:
        return json.loads(text)
    except ValueError:
        pass
    if found := re.search(r"\[.*?\]", text, re.S):
        try:
            return json.loads(found[0])
        except ValueError:
            pass
    decoder, out, at = json.JSONDecoder(), [], 0
    while start := re.compile(r"[{\[]").search(text, at):
        try:
            value, at = decoder.raw_decode(text, start.start())
            out += value if isinstance(value, list) else [value]
        except ValueError:
            at = start.start() + 1
    return out or None


def repaired(raw: Column) -> Column:
    """parse_answer as compact JSON with sorted keys; null where an answer holds none."""

    @F.pandas_udf("string")
    def mend(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (v := parse_answer(t)) is None else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return mend(raw)


def rows_from(df: DataFrame, hook: Callable[[dict], list[dict]] | None, schema: str, keep: list[str]) -> DataFrame:
    """hook(row) for each row of df (text or image to facts, rules, triples, table rows): its rows with df's columns in `keep`.

    Fields that a row lacks are null, others are left out.
    """
    kinds = StructType.fromDDL(schema)
    full = StructType([df.schema[c] for c in keep] + list(kinds))
    if hook is None:
        return df.sparkSession.createDataFrame([], full)
    names = [f.name for f in kinds]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [{**{c: row[c] for c in keep}, **{n: found.get(n) for n in names}} for row in part.to_dict("records") for found in hook(row) if isinstance(found, dict)]
            yield pd.DataFrame(made, columns=[*keep, *names])

    return df.mapInPandas(scan, full)


def facts_from_pages(pages: DataFrame, hook, keep: list[str]) -> DataFrame:
    """Facts of pages (text, ...): short pages are not asked about, longer ones with their first characters."""
    asked = pages.where(F.length(F.trim("text")) >= fixed.LEAST_FACT_TEXT).withColumn("text", F.substring("text", 1, fixed.FACT_TEXT))
    return rows_from(asked, hook, "fact_type string, subject string, attribute string, value string, unit string, context string, confidence double", keep)


def rules_from_pages(pages: DataFrame, hook, keep: list[str]) -> DataFrame:
    asked = pages.where(F.length(F.trim("text")) >= fixed.LEAST_RULE_TEXT)
    return rows_from(asked, hook, "clause string, rule_text string, attribute string, operator string, threshold string, unit string, condition string, severity string", keep)


def answers_from_chunks(chunks: DataFrame, hook, keep: list[str]) -> DataFrame:
    """raw: what the model says of each chunk; graph.parse_triples reads it."""
    return rows_from(chunks, hook, "raw string", keep)


def concepts_of(batches: DataFrame, hook: Callable[[list[str]], dict[str, list[str]]] | None) -> DataFrame:
    """doc_id, item, concepts for batches (doc_id, item, batch) of at most CONCEPT_BATCH items; without an answer an item has no concepts."""
    if hook is None:
        return batches.select("doc_id", "item", F.array().cast("array<string>").alias("concepts"))

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        said = hook(list(part["item"])) or {}
        said = said if isinstance(said, dict) else {}
        return pd.DataFrame({"doc_id": part["doc_id"], "item": part["item"], "concepts": [[x for x in got if isinstance(x, str)] if isinstance(got := said.get(i), list) else [] for i in part["item"]]})

    return batches.groupBy("doc_id", "batch").applyInPandas(ask, "doc_id string, item string, concepts array<string>")


def vectors_of(texts: DataFrame, hook: Callable[[list[str]], list[list[float]]], size: int, batch: int = 32) -> DataFrame:
    """text, embedding of distinct texts, asked in batches of 32; a batch that fails has zero vectors, which are near nothing."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[list[float]] = []
            for lo in range(0, len(part), batch):
                asked = list(part["text"][lo : lo + batch])
                try:
                    got = [list(map(float, v)) for v in hook(asked)]
                    out += got if len(got) == len(asked) and all(len(v) == size for v in got) else [[0.0] * size] * len(asked)
                except Exception:
                    out += [[0.0] * size] * len(asked)
            yield pd.DataFrame({"text": part["text"], "embedding": out})

    return texts.select("text").distinct().mapInPandas(scan, "text string, embedding array<float>")


def with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows with what verdicts (row_id, classification, severity, reason) say of the non-compliant ones; invalid or empty answers change nothing, weights follow severities."""
    from dossier.functions import expr as E

    v = verdicts.select("row_id", F.col("classification").alias("_c"), F.col("severity").alias("_s"), F.trim("reason").alias("_r")).dropDuplicates(["row_id"])
    asked = F.col("classification") == "Non-Compliant"
    take = lambda c, ok: F.when(asked & F.coalesce(ok, F.lit(False)), F.col(c))
    r = rows.join(v, "row_id", "left")
    r = r.withColumns({"_c": take("_c", F.col("_c").isin("Compliant", "Non-Compliant")), "_s": take("_s", F.col("_s").isin(*fixed.SEVERITIES[:4])), "_r": take("_r", F.col("_r") != "")})
    r = r.withColumns({"severity": F.coalesce("_s", "severity"), "reason": F.coalesce("_r", "reason"), "classification": F.coalesce("_c", "classification")})
    return r.withColumn("weight", E.weight(F.col("severity"))).drop("_c", "_s", "_r")


def sector_of(answer: Column) -> Column:
    """struct(sector, confidence) of a classifier's JSON answer; without one, the first sector at 0.1."""
    said = F.from_json(answer, "struct<sector: string, confidence: double>")
    return F.when(said["sector"].isNotNull(), F.struct(said["sector"].alias("sector"), F.coalesce(said["confidence"], F.lit(0.5)).alias("confidence"))).otherwise(F.struct(F.lit(fixed.SECTORS[0]).alias("sector"), F.lit(0.1).alias("confidence")))


def standard_of(answer: Column) -> Column:
    """The name of a standard that a model answers, without quotes; else `Unknown Standard`."""
    said = F.btrim(F.btrim(F.trim(F.coalesce(answer, F.lit(""))), F.lit('"')), F.lit("'"))
    return F.when(said == "", "Unknown Standard").otherwise(said)


def first_of(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key, in an order that is total. Rows are ranked in 64 parts of a key first, so no task sorts a whole key."""
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    near = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key, part).orderBy(*order))).where(F.col("_k") <= most)
    return near.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def reviewed(facts: DataFrame, hook: Callable[[list[dict]], list[dict]] | None, kind: str, least: int, order: list[Column], most: int) -> DataFrame:
    """doc_id, kind, severity, description, evidence: what a model finds in the first facts of each document that has at least `least`.

    hook gets those facts as a list; findings without a description are left out, without a severity they are MEDIUM.
    """
    schema = "doc_id string, kind string, severity string, description string, evidence string"
    if hook is None:
        return facts.sparkSession.createDataFrame([], schema)

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        said = hook(part.sort_values("_place").drop(columns="_place").to_dict("records")) if len(part) >= least else []
        rows = [x for x in said if isinstance(x, dict) and x.get("description")] if isinstance(said, list) else []
        return pd.DataFrame([(part["doc_id"].iloc[0], kind, x.get("severity") or "MEDIUM", x["description"], x.get("evidence", "")) for x in rows], columns=[c.split()[0] for c in schema.split(", ")])

    shown = first_of(facts, "doc_id", order, most).withColumn("_place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return shown.groupBy("doc_id").applyInPandas(ask, schema)


def consistency_review(facts: DataFrame, hook) -> DataFrame:
    """Sure facts by their page, at least five."""
    from dossier.operators import checks

    return reviewed(checks.measured(facts).where(F.col("confidence") > fixed.PROMPT_CONFIDENCE), hook, "llm_flagged", 5, [F.col("source_page"), F.col("fact_id")], fixed.PROMPT_FACTS)


def anomaly_review(facts: DataFrame, hook) -> DataFrame:
    """The first facts of a document, in the order of their ids."""
    from dossier.operators import checks

    return reviewed(checks.measured(facts), hook, "llm_flagged", 1, [F.col("fact_id")], fixed.ANOMALY_FACTS)


def page_graph(pages: DataFrame, answer, concept, cache: DataFrame | None = None, size: int = 5000, overlap: int = 150) -> dict[str, DataFrame]:
    """answers, triples, nodes, edges, concepts of pages (doc_id, page_num, sector, text): chunks go to the answer hook, items to the concept hook.

    Pages that cache (doc_id, page_num, raw, ...) has are not asked again, also where it has nothing of them. Pages of at most
    LEAST_GRAPH_TEXT characters are left out.
    """
    from dossier.operators import graph
    from dossier.operators.pages import chunks_of
    from dossier.sources import sinks

    new, _ = sinks.uncached(pages.where(F.length(F.trim("text")) > fixed.LEAST_GRAPH_TEXT), cache)
    keep = ["doc_id", "page_num", "sector"]
    chunks = rows_from(new, lambda row: [{"chunk": k, "text": t} for k, t in enumerate(chunks_of(row["text"], size, overlap))], "chunk int, text string", keep)
    answers = answers_from_chunks(chunks, None if answer is None else lambda row: [{"raw": answer(row["text"], row["sector"])}], [*keep, "chunk"])
    if cache is not None:
        answers = cache.select(answers.columns).unionByName(answers)
    seq = (F.col("page_num") * 1000 + F.col("chunk")).cast("long")
    triples = graph.parse_triples(answers.select("doc_id", (F.col("page_num") + 1).alias("source_page"), "sector", seq.alias("seq"), "raw"))
    items = concepts_of(graph.concept_batches(triples), concept)
    concepts = items.withColumn("concepts", graph.clean_concepts(F.col("concepts"))).join(triples.select("doc_id", "sector").distinct(), "doc_id")
    return {"answers": answers, "triples": triples, "nodes": graph.kg_nodes(triples), "edges": graph.kg_edges(triples), "concepts": graph.concept_nodes(concepts)}
