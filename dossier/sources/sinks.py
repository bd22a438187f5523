"""Tables that stay: stored rows by merge key, reports, state, caches and vector indexes as files of a folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import graph


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a stored table, oldest first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a stored table, None where there is none."""
    found = versions(spark, path)
    return _there(spark, f"{path}/v{found[-1]}") if found else None


def _store(rows: DataFrame, path: str) -> DataFrame:
    """A version of its own, written whole before it is read: a job that dies leaves the one before."""
    spark = rows.sparkSession
    new = f"{path}/v{(versions(spark, path) or [0])[-1] + 1}"
    rows.write.mode("overwrite").parquet(new)
    return spark.read.parquet(new)


def merge(rows: DataFrame, path: str, key: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """Stores rows (with a column seq) over those of the same key: the last row wins, the columns in `first` keep their first value."""
    old = load(rows.sparkSession, path)
    both = rows.withColumn("_new", F.lit(1)) if old is None else old.withColumns({"_new": F.lit(0), "seq": F.lit(-1).cast(dict(rows.dtypes)["seq"])}).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_order", F.struct("_new", "seq"))
    return _store(graph.upsert(both.drop("_new", "seq"), key, "_order", first), path)


def append_missing(rows: DataFrame, path: str, id_col: str) -> DataFrame:
    """Stores the rows whose id is not there yet."""
    old = load(rows.sparkSession, path)
    return _store(rows.dropDuplicates([id_col]) if old is None else old.unionByName(rows.dropDuplicates([id_col]).join(old.select(id_col), id_col, "left_anti").select(old.columns)), path)


def accumulate(edges: DataFrame, path: str) -> DataFrame:
    """Stores edges beside those that are there; none is lost."""
    old = load(edges.sparkSession, path)
    return _store((edges if old is None else old.unionByName(edges)).distinct(), path)


def forget(spark: SparkSession, path: str, doc_ids: list[str]) -> DataFrame | None:
    """Stores the table without these documents, so that they are built anew."""
    old = load(spark, path)
    return None if old is None else _store(old.where(~F.col("doc_id").isin(*doc_ids)), path)


def write_report(rows: DataFrame, path: str, partition: str | None = "doc_id") -> None:
    """Rows as JSON lines, in a folder for each document."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).json(path)


def uncached(pages: DataFrame, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pages that were not worked on yet, those that were, with or without results); cache: doc_id, page_num, ..."""
    if cache is None:
        return pages, pages.limit(0)
    done = cache.select("doc_id", "page_num").distinct()
    return pages.join(done, ["doc_id", "page_num"], "left_anti"), pages.join(done, ["doc_id", "page_num"], "left_semi")


def save_index(vectors: DataFrame, path: str) -> DataFrame:
    """id, label and vector of an index, as a stored table."""
    return _store(vectors, path)


def hand_on(spark: SparkSession, path: str, step: str, **values: str) -> dict[str, dict[str, str]]:
    """Writes what a step hands to the next ones and returns all of it, by step."""
    row = spark.createDataFrame([(0, step, {k: str(v) for k, v in values.items()})], "seq int, step string, state map<string,string>")
    return {r.step: dict(r.state) for r in merge(row, path, ["step"]).collect()}  # a row for each step


def show(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text, for a console."""
    return df.limit(rows).toPandas().to_string(index=False)
