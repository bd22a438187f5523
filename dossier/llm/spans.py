"""What finds long repeated spans of words and of bytes: texts that are judged, anchors, a filter of repeated anchors, masks.

A window of W tokens holds W - K + 1 runs of K tokens; the one with the least hash (leftmost among equals) is its anchor,
so equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor are a stretch. Stretches whose
anchor occurs in one text only are left out before they are sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import BROADCAST_IDS, in_arrow, materialize, sliding_min

#: A text is hot with more than this share of all rows.
HOT_SHARE = 0.001
#: Anchors that a task holds before they are sent.
HELD = 1 << 20
#: Bits of the filter of repeated anchors for each of them, and at most: beyond, it lets more stretches through.
FILTER_BITS, FILTER_MOST = 32, 1 << 30
_PLACE_BITS = np.uint64(24)


def units(docs: DataFrame, id_col: str, text_col: str):
    """(thin, texts, copies): rows (_id, _text, _key) of docs; those whose repeats are judged, each once; a function that adds `copy` to rows.

    A copy of a smaller document's text loses every window and says nothing that the other doesn't, so it is not among
    texts. _key tells texts under one id apart. Null texts are empty, rows without id are not judged.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    named = thin.withColumn("_h", F.sha2("_text", 256)).withColumn("_key", F.xxhash64("_h"))
    keys = materialize(named.where("_id is not null").select("_id", "_key", "_h"), "spans-keys")
    repeated = materialize(keys.groupBy("_h").agg(F.min("_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "spans-classes")
    is_hot = F.col("n") > F.lit(max(2, keys.count() * HOT_SHARE))
    hot = F.broadcast(repeated.where(is_hot).select("_h", "rep"))  # fewer than 1 / HOT_SHARE
    found = keys.join(hot, "_h").unionByName(keys.join(hot.select("_h"), "_h", "left_anti").join(repeated.where(~is_hot).select("_h", "rep"), "_h"))
    gone = materialize(found.where("_id > rep").select("_id", "_key").distinct(), "spans-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    again = materialize(found.where("_id = rep").groupBy("_id", "_key").count().where("count > 1").select("_id", "_key"), "spans-again")
    thin = named.select("_id", "_text", "_key")
    texts = thin.where("_id is not null").join(gone, ["_id", "_key"], "left_anti")
    if not again.isEmpty():  # rows that repeat both id and text are one
        few = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
        texts = texts.join(few, ["_id", "_key"], "left_anti").unionByName(texts.join(few, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]))

    def copies(rows: DataFrame) -> DataFrame:
        return rows.join(gone.withColumn("copy", F.lit(True)), ["_id", "_key"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))

    return thin, texts.select("_id", "_key", "_text"), copies


def runs_of(mask: np.ndarray) -> np.ndarray:
    """(n, 2) starts and ends of the true stretches."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges.reshape(-1, 2)


def covered(n: int, starts: list[int], ends: list[int], window: int) -> np.ndarray:
    """Which of n tokens a shared window covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.array(starts, np.int64), 1)
    np.add.at(change, np.minimum(np.array(ends, np.int64) - 1 + window, n), -1)
    return np.cumsum(change[:-1]) > 0


class Stretches:
    """The stretches of windows of some texts whose tokens stand side by side: first window, number of windows, place and hash of the anchor, owner (number of the text).

    h: hash of each run of k tokens; lengths: tokens of each text, a window at least.
    """

    def __init__(self, h: np.ndarray, lengths: np.ndarray, window: int, k: int):
        ends = np.cumsum(lengths)
        self.bases = ends - lengths
        keyed = ((h >> _PLACE_BITS) << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(keyed, window - k + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        whole = np.ones(len(at) + window, bool)
        whole[(ends[:, None] - np.arange(1, window)).ravel()] = False
        whole = whole[: len(at)]
        new = np.concatenate(([True], at[1:] != at[:-1]))
        self.first = np.flatnonzero(whole & (new | ~np.concatenate(([False], whole[:-1]))))
        last = np.flatnonzero(whole & np.concatenate((new[1:] | ~whole[1:], [True])))
        self.windows = last - self.first + 1
        self.place = at[self.first]
        self.hash = h[self.place]
        self.owner = np.searchsorted(self.bases, self.first, "right") - 1


#: Batches of (_id, _key, _text) to (stretches, and of each of their texts: number in this task, id, key, place of its first token).
Parts = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]


def _anchors(parts: Parts, slice_bits: int):
    """Different anchors of each slice of their hashes, as 32 bits each, and whether two texts of this task have them."""

    def packed(h: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h)
        h, text = h[order], text[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        twice = np.minimum.reduceat(text, starts) != np.maximum.reduceat(text, starts)
        h = h[starts]
        rest = ((h >> np.uint64(32 - slice_bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        cuts = np.searchsorted(h >> np.uint64(64 - slice_bits), np.arange((1 << slice_bits) + 1).astype(np.uint64))
        of = [(s, a, z) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if a < z]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in of], pa.int32()), pa.array([rest[a:z].tobytes() for _, a, z in of], pa.binary()), pa.array([np.packbits(twice[a:z]).tobytes() for _, a, z in of], pa.binary())], ["slice", "rest", "twice"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, n = [], [], 0
        for part, number, *_ in parts(batches):
            held.append(part.hash)
            texts.append(number[part.owner])
            n += len(part.hash)
            if n >= HELD:
                yield packed(np.concatenate(held), np.concatenate(texts))
                held, texts, n = [], [], 0
        if n:
            yield packed(np.concatenate(held), np.concatenate(texts))

    return scan


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice, the anchors that two texts have."""
    held: dict[int, list] = {}
    for b in batches:
        for s, rest, twice in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            x = np.frombuffer(rest, np.uint32)
            held.setdefault(s, []).append((x, np.unpackbits(np.frombuffer(twice, np.uint8), count=len(x)).astype(bool)))
    for s, got in held.items():
        x, twice = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(x)
        x, twice = x[order], twice[order]
        again = np.concatenate(([False], x[1:] == x[:-1]))
        x = np.unique(x[twice | again])
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["slice", "n", "rest"])


class Filter:
    """Whether an anchor may be a repeated one."""

    def __init__(self, table: bytes, slice_bits: int, cell_bits: int):
        self.table, self.shift = np.frombuffer(table, np.uint8), np.uint64(64 - slice_bits - cell_bits)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        cell = h >> self.shift
        return ((self.table[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


def packed_filter(repeated: DataFrame, slice_bits: int) -> tuple[bytes, int]:
    """(a bit for each cell of each slice, bits of a cell's number within its slice)."""
    count = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cell_bits = min(max(3, (count * FILTER_BITS >> slice_bits).bit_length()), FILTER_MOST.bit_length() - 1 - slice_bits, 32)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, rest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                there = np.zeros(1 << cell_bits, bool)
                there[np.frombuffer(rest, np.uint32) >> np.uint32(32 - cell_bits)] = True
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(there).tobytes()], pa.binary())], ["slice", "bits"])

    table = np.zeros((1 << slice_bits, 1 << cell_bits >> 3), np.uint8)
    for s, bits in repeated.select("slice", "rest").mapInArrow(mark, "slice int, bits binary").collect():  # FILTER_MOST bits in all
        table[s] = np.frombuffer(bytes(bits), np.uint8)
    return table.tobytes(), cell_bits


def anchor_filter(texts: DataFrame, parts: Parts, name: str) -> tuple[bytes, int, int]:
    """The arguments of Filter, for the anchors that two rows of texts (_id, _key, _text) have."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a slice of the anchors' hashes goes to one task: a few million of them
    slice_bits = max(4, (size >> 25).bit_length(), least.bit_length() - 1)
    tasks = min(1 << slice_bits, 4 * least)
    met = texts.transform(in_arrow, _anchors(parts, slice_bits), "slice int, rest binary, twice binary")
    repeated = materialize(met.repartitionById(tasks, F.pmod("slice", F.lit(tasks))).transform(in_arrow, _repeated, "slice int, n long, rest binary"), name)
    table, cell_bits = packed_filter(repeated, slice_bits)
    return table, slice_bits, cell_bits
