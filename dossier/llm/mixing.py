"""Mixing sources to target weights by balanced sampling (the cube method)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import WORD, materialize

#: Weights of the sources in code point order, repeating; the mix's share of all words; how often a document may be repeated.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents of a source that fly together, about.
BLOCK = 4096
#: Documents of a block that do not fly.
RESERVE = 10
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """rank, source, rows, source_size, target for each source of sizes (source, size).

    Sources in code point order, null last, take the weights in turn and share `share` times all
    words; no target is above `most` times its source's size. Resharing the excess by weight until none
    is above fills up to one level: the sources with least room for their weight are full, the
    others get level * weight. One row per source is sorted here, never documents.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("rank", F.row_number().over(in_order).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double")
    room = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", "rank")
    everything = Window.partitionBy()
    full = room.withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn(
        "open", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    at = (F.sum("source_size").over(everything) * F.lit(share) - F.col("before")) / F.col("open")
    first = F.min(F.when(F.col("at") <= F.col("level"), F.struct("level", "rank", "at"))).over(everything)  # the first source that is not full
    filled = full.withColumn("at", at).withColumn("fill", first["at"])
    return filled.select("rank", "source", "rows", "source_size", F.least("cap", F.coalesce(F.col("fill") * F.col("weight"), F.col("cap"))).alias("target"))


def move(units: list[list], random: Random) -> None:
    """One flight step of three units [p, size, ...]: along the null vector of (documents, tokens), until a unit is at 0 or 1."""
    (a, b, c) = (u[1] for u in units)
    u = (c - b, a - c, b - a)
    if not any(u):
        u = (1, -1, 0)
    up = min((1 - x[0]) / d if d > 0 else x[0] / -d for x, d in zip(units, u) if d)
    down = min(x[0] / d if d > 0 else (1 - x[0]) / -d for x, d in zip(units, u) if d)
    step = up if random.random() * (up + down) < down else -down
    for x, d in zip(units, u):
        x[0] += step * d


def land(units: list[list]) -> None:
    """The few units that are left go to the corner whose tokens, then documents, are nearest."""
    if not units:
        return
    corners = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    p, size = np.array([x[0] for x in units]), np.array([x[1] for x in units], float)
    off, short = np.abs((corners - p) @ size), np.abs((corners - p).sum(1))
    best = corners[np.lexsort((short.round(6), off.round(3)))[0]]
    for x, q in zip(units, best):
        x[0] = float(q)


def fly(rows: Iterator[tuple], last: bool) -> Iterator[tuple]:
    """rows: (group, p, size, rest), groups together, in a fixed order.

    Yields (p, size, rest), where p is 0 or 1 for all but RESERVE + 2 rows of a group, for all if last. The
    reserve stays on the ground, so that landing has corners enough to choose from. Holds no more rows
    than that at a time.
    """
    group, units, waiting, random = None, [], deque(), Random(0)

    def settled():
        for x in units[:]:
            if x[0] < _EPS or x[0] > 1 - _EPS:
                x[0] = float(x[0] > 0.5)
                units.remove(x)
                yield tuple(x)

    def ends():
        left = units + [x for x in waiting if 0 < x[0] < 1]
        if last:
            land(left)
        yield from (tuple(x) for x in left)
        units.clear()
        waiting.clear()

    for g, p, size, rest in rows:
        if g != group:
            yield from ends()
            group, random = g, Random(hash(g))
        if p < _EPS or p > 1 - _EPS:
            yield float(p > 0.5), size, rest
            continue
        waiting.append([p, size, rest])
        if len(waiting) > RESERVE:
            units.append(waiting.popleft())
        while len(units) == 3:
            move(units, random)
            yield from settled()
    yield from ends()


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs.

    A document is taken `target / source_size` times on average: the whole part for certain, the rest by
    the cube method, which keeps each source's taken words and documents at their expected totals until
    a dozen documents of the source are left to land. Blocks of a source fly on their own; what they leave
    flies again in fewer blocks, so no task and not the driver ever holds a source. Random
    numbers come from block numbers, blocks from hashes of ids, so reruns agree.

    A null text has size 0 and takes 0 words; a null source is one source, the last; rows that repeat an
    id are drawn one by one; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    sizes = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sizes = materialize(sizes, "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, most), "mix-targets")
    largest, sources = targets.agg(F.coalesce(F.max("rows"), F.lit(0)), F.count("*")).first()
    at = F.broadcast(targets) if sources <= 100_000 else targets
    drawn = sizes.join(at, sizes["source"].eqNullSafe(targets["source"])).select(
        "_id", sizes["source"], "size", "rank", "source_size", "target", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias("rate"),
        F.ceil(F.col("rows") / block).alias("blocks"), F.xxhash64("_id", F.lit(7)).alias("order"),
    )
    drawn = drawn.withColumn("base", F.floor("rate")).withColumn("p", F.col("rate") - F.col("base")).withColumn("block", F.pmod("order", "blocks"))
    columns = ["_id", "source", "size", "rank", "source_size", "target", "base", "order", "block", "p"]
    schema = drawn.select(*columns).schema
    index = {c: k for k, c in enumerate(columns)}

    def flight(last: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow = None

            def rows():
                nonlocal arrow
                for b in batches:
                    arrow = b.schema
                    for r in zip(*(c.to_pylist() for c in b.columns)):
                        yield (r[index["rank"]], r[index["block"]]), r[index["p"]], r[index["size"]], r

            out = []
            for p, _, r in fly(rows(), last):
                out.append(r[:-1] + (p,))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], columns)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], columns)

        return scan

    left, done, blocks = drawn.select(*columns), [], max(1, -(-largest // block))
    while True:
        flown = left.repartition("rank", "block").sortWithinPartitions("rank", "block", "order", "_id", "size").mapInArrow(flight(blocks == 1), schema)
        flown = materialize(flown, "mix-flown")
        if blocks == 1:
            done.append(flown)
            break
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~is_open))
        fewer = max(1, block // 4)
        left, blocks = flown.where(is_open).withColumn("block", F.expr(f"block div {fewer}")).select(*columns), -(-blocks // fewer)
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    copies = (F.col("base") + F.col("p")).cast("long")
    return whole.select(F.col("_id").cast(kind).alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
