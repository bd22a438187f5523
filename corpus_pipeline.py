"""Five stages from raw documents to a training mix. Each is written as Parquet and read again as the next one's documents.

Stages take and return any columns besides doc_id, text and source, whatever their names; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import materialize, numbered, only
from dossier.llm.decontaminate import drop_contaminated
from dossier.llm.exact_dedup import exact_dedup
from dossier.llm.mixing import mix_sources
from dossier.llm.ngram_join import link_components
from dossier.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic. A null text has no signal and stays; all rows are judged by themselves."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id; null and empty texts are one group.

    Where ids are missing or repeated, rows are told apart by numbers of their own, so that no other text under the same id goes.
    """
    rows = numbered(docs)
    found = exact_dedup(rows.select("row", F.col("doc.text").alias("text")), "row")
    return only(rows, found.where("not kept").select(F.col("doc_id").alias("row")), "row", "left_anti").select("doc.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked shingle sets, the one with the smallest id; wordless texts link with nothing and stay. Rows as in exact."""
    rows = numbered(docs)
    found = link_components(rows.select("row", F.col("doc.text").alias("text")), "row")
    return only(rows, found.where("doc_id <> component_id").select(F.col("doc_id").alias("row")), "row", "left_anti").select("doc.*")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. A null text has none and stays."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, with how often the mix takes each (copies) and what led to it. Names that documents have already get `mix_` before them."""
    rows = numbered(docs)
    taken = mix_sources(rows.select("row", F.col("doc.text").alias("text"), F.col("doc.source").alias("source")), "row")
    more = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in ("size", "source_size", "target", "copies", "taken")]
    return rows.join(taken.withColumnRenamed("doc_id", "row"), "row").select("doc.*", *more)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", leaks), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs


#: A learned score has no SQL.
ORACLE_SQL = None
