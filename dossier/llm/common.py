"""What the corpus operators share: tables cut off in the shared folder, words, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of other characters than these.
WORD = "[^\\x20\\x09-\\x0D]+"
_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one serves a session that is all on this machine; on a cluster that raises."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="dossier-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later jobs need neither its lineage nor an executor's disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(row, doc): each row of docs as a struct, with a number of its own: its id where ids are there and different, else one that is written down first."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"))
    if ids.groupBy("i").agg(F.count("*").alias("n")).where("i is null or n > 1").isEmpty():
        return docs.select(F.col(f"`{id_col}`").cast("long").alias("row"), doc)
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), doc), "numbered")


#: Bytes after which a batch for Python ends, where the session leaves Spark's default of 64 MB: batches of
#: whole texts stand several times in the memory of an executor and of each of its Python workers.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def free_memory() -> None:
    """Gives what a Python worker no longer uses back to the system; Spark keeps workers for later tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def in_arrow(df: DataFrame, scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(scan, schema) in batches of bounded bytes; each task frees its memory at its end."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) in ("67108864b", "64MB"):
        conf.set(_BATCH_KEY, str(BATCH_BYTES))

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        free_memory()

    return df.mapInArrow(freed, schema)


def lower_ascii(c: Column) -> Column:
    """A-Z only. lower() is many times faster and says the same of texts that hold no other than ASCII characters."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lower_ascii_bytes(text: bytes) -> bytes:
    return text.translate(_ASCII_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; x: uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Known(dict):
    """Hashes of words, made when first asked for."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        made = self[word] = self.hash(word)
        return made


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 300_000):
        self.known, self.most = _Known(), most

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def rolling(tokens: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of each run of k tokens; tokens: uint64. Polynomial in an odd base, so equal runs have equal hashes wherever they stand."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    if k <= 8:
        for j in range(k):
            out *= base
            out += tokens[j : j + n]
        return mix(out)
    done, power, have, step = np.zeros(n, np.uint64), 0, tokens, 1
    at = 0  # doubling: hashes of 1, 2, 4 ... tokens, put together by the bits of k
    while True:
        if k & step:
            p = np.uint64(pow(int(base), step, 1 << 64))
            done = done * p + have[at : at + n]
            at += step
        step *= 2
        if step > k:
            return mix(done)
        p = np.uint64(pow(int(base), step // 2, 1 << 64))
        have = have[: len(have) - step // 2] * p + have[step // 2 :]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours."""
    if len(x) < w:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


#: Rows of ids that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def only(rows: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """rows whose `on` is in ids (how left_anti: is not). ids is counted first: a small one spares rows their shuffle, a large one is joined by it."""
    ids = materialize(ids.select(on).distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)
