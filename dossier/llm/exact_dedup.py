"""Exact dedup by an extendible-hash index on shared files, in DataFrame functions only.

A directory of 2 ** depth cells points to buckets; it doubles, and buckets that hold too much split, until every bucket
fits. Neighbouring buckets are the key range of an owner task, which compares the bytes of its rows and chains
different texts with the same hash. Rows find their text through the directory, the bucket and the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import BROADCAST_IDS, lower_ascii, materialize

#: Entries (different hashes) that a bucket holds before it is split; more only where there would be more buckets than MOST_BUCKETS.
BUCKET_CAPACITY, MOST_BUCKETS = 20_000, 1 << 16
#: Bits that the directory grows by at a time, and the bits of a hash.
STEP, HASH_BITS = 4, 64
#: A group is hot with more than this share of all rows, so there are fewer hot groups than its inverse.
HOT_SHARE = 0.001


def _prefix(bits: int):
    """The first bits of the hash h."""
    return F.shiftrightunsigned("h", HASH_BITS - bits) if bits else F.lit(0).cast("long")


def directory(slots: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(cells, depth). cells: cell, bucket, bucket_depth, held: for each cell of depth bits that holds something, the bucket it points to.

    slots has one row for each different hash h. The directory doubles while a bucket at its depth is above capacity,
    up to all bits of the hash, where each bucket has one entry. The bucket of a cell is its shortest
    prefix that fits.
    """
    depth, cells = 0, None
    while True:
        cells = materialize(slots.groupBy(_prefix(depth).alias("cell")).agg(F.count("*").alias("n")), "dedup-cells")
        if depth == HASH_BITS or cells.where(F.col("n") > capacity).isEmpty():
            break
        depth += STEP
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bucket_depth"))
    levels = levels.withColumn("bucket", F.expr(f"if(bucket_depth = 0, 0L, shiftrightunsigned(cell, {depth} - bucket_depth))"))
    held = levels.groupBy("bucket_depth", "bucket").agg(F.sum("n").alias("held"))
    fits = levels.join(held.where((F.col("held") <= capacity) | (F.col("bucket_depth") == depth)), ["bucket_depth", "bucket"])
    first = fits.groupBy("cell").agg(F.min(F.struct("bucket_depth", "bucket", "held")).alias("b"))
    return first.select("cell", "b.bucket", "b.bucket_depth", "b.held"), depth


def _owned(cells: DataFrame, depth: int, owners: int) -> DataFrame:
    """cells with the owner of each: key ranges of about the same number of entries. A row for each cell, of which there are few."""
    start = F.expr(f"shiftleft(bucket, {depth} - bucket_depth)")
    buckets = cells.select("bucket", "bucket_depth", "held", start.alias("start")).distinct()
    upto = F.sum("held").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("held").over(Window.partitionBy())
    owned = buckets.select("bucket", "bucket_depth", F.floor(F.coalesce(upto, F.lit(0)) * owners / total).cast("int").alias("owner"))
    return cells.join(owned, ["bucket", "bucket_depth"]).select("cell", "bucket", "bucket_depth", "owner")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(keys, index), both files in the shared folder. keys: one row per document, _id, h, sha, bucket, bucket_depth. index: one row per different text, bucket, bucket_depth, h, chain, sha, keep_id, group_size.

    Texts with very many copies are combined where they are read, so each comes once per task; all others go whole to the owner of
    their bucket, which groups equal bytes. Texts with the same hash get consecutive chain numbers.
    """
    spark = docs.sparkSession
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    read = docs.select(F.col(id_col).alias("_id"), norm.alias("norm")).withColumn("h", F.xxhash64("norm"))
    thin = materialize(read.select("_id", "h", F.sha2("norm", 256).alias("sha")), "dedup-thin")
    slots = materialize(thin.groupBy("h").agg(F.count("*").alias("n")), "dedup-slots")
    hashes, rows = slots.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    cells, depth = directory(slots.select("h"), max(capacity, hashes // MOST_BUCKETS))
    owners = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    points = materialize(_owned(cells, depth, owners), "dedup-directory")
    points = F.broadcast(points) if points.count() <= BROADCAST_IDS else points
    at = lambda df: df.withColumn("cell", _prefix(depth)).join(points, "cell").drop("cell")
    hot = slots.where(F.col("n") > F.lit(max(2, rows * HOT_SHARE))).select("h")  # fewer than 1 / HOT_SHARE
    key = ["owner", "bucket", "bucket_depth", "h", "norm"]
    same = [F.max("_id").alias("keep_id"), F.count("*").alias("group_size")]
    cold = at(read.join(F.broadcast(hot), "h", "left_anti")).repartition(owners, "owner").groupBy(*key).agg(*same)
    warm = at(read.join(F.broadcast(hot), "h", "left_semi")).groupBy(*key).agg(*same)
    # a hash is hot or not, so its chain is in one of the two
    chain = F.row_number().over(Window.partitionBy("owner", "bucket", "bucket_depth", "h").orderBy("sha"))
    entries = [e.select(*key[:-1], F.sha2("norm", 256).alias("sha"), "keep_id", "group_size").withColumn("chain", chain).drop("owner") for e in (cold, warm)]
    return at(thin).drop("owner"), materialize(entries[0].unionByName(entries[1]), "dedup-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, chain for each row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty
    texts form one group. The largest id of a group stays; rows that repeat that id are one document
    and stay together; with null ids only, keep_id is null and the rows stay. Texts of any length are compared whole.
    Other columns of docs are ignored. An empty table gives an empty result.
    """
    keys, index = build_index(docs, id_col, text_col, capacity)
    place = ["bucket", "bucket_depth", "h", "sha"]  # bucket, then the entry of the chain that has the row's bytes
    is_hot = F.col("group_size") > F.lit(max(index.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0] * HOT_SHARE, 1))
    hot = keys.join(F.broadcast(index.where(is_hot)), place)  # under 1 / HOT_SHARE rows
    cold = keys.join(F.broadcast(index.where(is_hot).select(*place)), place, "left_anti").join(index.where(~is_hot), place)
    both = hot.unionByName(cold)
    return both.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("bucket", "chain")


OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
