"""Long repeated spans of bytes by a sparse suffix array.

Windows have anchors, at equal offsets where they are equal (see spans). Only suffixes that start at anchors go through the
shuffle: each brings the stretch of neighbouring windows that it anchors, their shared bytes once. Sampled splitters
over the leading bytes deal the suffixes out in ranges; a range's owner sorts by multikey quicksort and compares
neighbours byte by byte. Where one anchor fills several ranges, its windows are suffixes of their own, dealt by all
of their bytes and their document, and ranges that end inside a run of equal ones settle it across their boundary.
Hashes choose anchors and rule suffixes out that cannot meet; they never decide that bytes are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import in_arrow, materialize, mix
from dossier.llm.spans import HELD, Filter, Stretches, anchor_filter, covered, runs_of, units

WINDOW, ANCHOR = 50, 24
#: Bytes of texts that are looked at together; a longer text is cut into parts that overlap by a window less one byte.
PART = 1 << 19
#: Suffixes of a range, as the sample has it.
RANGE = 150_000
#: Texts and suffixes of a text that splitters are drawn from, at most. They decide how even ranges are, nothing else.
SAMPLE_TEXTS, SAMPLE_OF_TEXT = 2000, 500
_MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts as they do; data: uint8."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,)).astype(np.uint64)


def depths(length: int) -> list[int]:
    """Places of the eights that together hold so many bytes, in order; the last may overlap."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])] if length >= 8 else [0]


def eight_at(words: np.ndarray, at: np.ndarray | slice, length: int) -> np.ndarray:
    x = words[at]
    return x >> np.uint64(64 - 8 * length) if length < 8 else x


def strings(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes from each place. All are equally long, so numpy's comparisons, blind to trailing zeros, tell them apart."""
    return np.ndarray((max(0, len(data) - length + 1),), f"S{length}", data, strides=(1,))[at]


class Part(Stretches):
    """The stretches of some texts, and their bytes."""

    def __init__(self, texts: list[bytes], window: int, k: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join([*texts, bytes(64)]), np.uint8)
        words = eights(self.data)
        h = np.zeros(int(lengths.sum()) - k + 1, np.uint64)
        for d, c in zip(depths(k), _MIXERS):
            h += eight_at(words, slice(d, d + len(h)), k) * np.uint64(c)
        super().__init__(mix(h), lengths, window, k)

    def bytes_of(self, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.data[np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]


def parts(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[tuple[Part, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, and of each of its texts: number in this task, id, key, place of its first byte) of the rows (_id, _key, _text)."""
    texts, of, size, number = [], [], 0, 0

    def made():
        return (Part(texts, window, k), *(np.array(x, np.int64) for x in zip(*of)))

    for b in batches:
        for i, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            text = t.as_py()
            number += 1
            for lo in range(0, len(text) - window + 1, PART):
                texts.append(text[lo : lo + PART + window - 1])
                of.append((number, i, key, lo))
                size += len(texts[-1])
                if size >= PART:
                    yield made()
                    texts, of, size = [], [], 0
    if texts:
        yield made()


class Splitters:
    """Ranges of suffixes. cold: leading bytes at which a range ends; hot: those that fill more than one, whose windows have ranges of their own, which end at `windows` and `ids`."""

    def __init__(self, anchors: np.ndarray, stretches: list[tuple[bytes, int]], window: int, k: int, ranges: int):
        order = np.argsort(anchors)
        at = (np.arange(1, ranges) * len(order) // max(1, ranges)).astype(np.int64)
        cuts = anchors[order][at] if len(order) else anchors
        self.cold, often = np.unique(cuts, return_counts=True)
        self.hot = self.cold[often > 1]
        self.k, self.window = k, window
        found = [(x[j : j + window], i, n) for n, (x, i) in enumerate(stretches) if self._is_hot(anchors[n]) for j in range(len(x) - window + 1)]
        found.sort()
        more = min(len(found), -(-ranges * len({n for _, _, n in found}) // max(1, len(stretches))))
        cut = [found[j * len(found) // more] for j in range(1, more)]
        self.windows = np.array([c[0] for c in cut], f"S{window}")
        self.ids = np.array([c[1] for c in cut], np.int64)

    def _is_hot(self, anchor) -> bool:
        j = int(np.searchsorted(self.hot, anchor))
        return j < len(self.hot) and self.hot[j] == anchor

    def is_hot(self, anchors: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(anchors), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, anchors), len(self.hot) - 1)] == anchors

    def of_anchors(self, anchors: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cold, anchors, "right")

    def of_windows(self, windows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, number of the run of equal splitters that the window is in, or -1)."""
        lo, hi = np.searchsorted(self.windows, windows, "left"), np.searchsorted(self.windows, windows, "right")
        at = hi.copy()
        for s in np.unique(lo[lo < hi]):
            which = np.flatnonzero((lo == s) & (hi > s))
            at[which] = s + np.searchsorted(self.ids[s : hi[which[0]]], ids[which], "right")
        return at + len(self.cold) + 1, np.where(lo < hi, lo, -1)


def _sampled(window: int, k: int, sent):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = Filter(*sent.value)
        for part, _, ids, _, _ in parts(batches, window, k):
            keep = np.flatnonzero(there(part.hash))
            n = len(keep)
            which = []
            for j in np.unique(part.owner[keep]):
                own = keep[part.owner[keep] == j]
                which.append(own[:: -(-len(own) // SAMPLE_OF_TEXT)])
            pick = np.concatenate(which) if which else keep
            rows = [part.data[f : f + w + window - 1].tobytes() for f, w in zip(part.first[pick], part.windows[pick])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array((part.place - part.first)[pick], pa.int32()), pa.array(ids[part.owner[pick]], pa.int64()), pa.array([n] * bool(len(rows)) + [0] * (len(rows) - 1), pa.int64())], ["stretch", "at", "id", "n"])

    return scan


def _dealt(window: int, k: int, sent, splitters):
    """Suffixes that may meet others, packed by range: ids, keys, first windows, numbers of windows, bytes."""
    names = ["range", "run", "ids", "keys", "starts", "windows", "blob"]

    def packed(held: list[tuple]) -> pa.RecordBatch:
        to, run, ids, keys, starts, windows = (np.concatenate([h[j] for h in held]) for j in range(6))
        lengths = windows + window - 1
        blob = np.concatenate([h[6] for h in held])
        begin = np.cumsum(lengths) - lengths
        order = np.lexsort((run, to))
        cut = np.flatnonzero(np.concatenate(([True], (to[order][1:] != to[order][:-1]) | (run[order][1:] != run[order][:-1]))))
        rows = []
        for own in np.split(order, cut[1:]):
            n = lengths[own]
            at = np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows.append((int(to[own[0]]), int(run[own[0]]), ids[own].tobytes(), keys[own].tobytes(), starts[own].tobytes(), windows[own].astype(np.int32).tobytes(), blob[at].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int32() if j < 2 else pa.binary()) for j in range(7)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, ranges = Filter(*sent.value), splitters.value
        held, n = [], 0
        for part, _, ids, keys, lows in parts(batches, window, k):
            keep = np.flatnonzero(there(part.hash))
            anchors = strings(part.data, part.place[keep], k)
            hot = ranges.is_hot(anchors)
            for own, single in ((keep[~hot], False), (keep[hot], True)):
                first, windows, owner = part.first[own], part.windows[own], part.owner[own]
                if single:
                    owner = np.repeat(owner, windows)
                    first = np.repeat(first - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
                    windows = np.ones(len(first), np.int64)
                if not len(first):
                    continue
                if single:
                    to, run = ranges.of_windows(strings(part.data, first, window), ids[owner])
                else:
                    to, run = ranges.of_anchors(anchors[~hot]), np.full(len(first), -1)
                held.append((to, run, ids[owner], keys[owner], first - part.bases[owner] + lows[owner], windows, part.bytes_of(first, windows + window - 1)))
                n += len(held[-1][6])
            if n >= 16 * HELD:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return scan


def alike(words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at these places, eight bytes at a time: (their order by `length` bytes, whether each differs from its neighbour before)."""
    key = eight_at(words, at, length)
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    for d in depths(length)[1:]:
        # only runs that are equal so far are looked at further
        open_ = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
        if not len(open_):
            break
        run = np.cumsum(new[open_])
        key = words[at[order[open_]] + d]
        sort = np.lexsort((key, run))
        order[open_] = order[open_[sort]]
        key, run = key[sort], run[sort]
        new[open_] = np.concatenate(([True], (key[1:] != key[:-1]) | (run[1:] != run[:-1])))
    return order, new


def least_ids(stretches: list[bytes], ids: np.ndarray, window: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id in which each window of the stretches occurs, first window of each stretch). Stretches with a common window are neighbours, or there are few."""
    lengths = np.array([len(x) for x in stretches], np.int64)
    windows = lengths - window + 1
    data = np.frombuffer(b"".join([*stretches, bytes(64)]), np.uint8)
    words = eights(data)
    begin = np.cumsum(lengths) - lengths
    first = np.cumsum(windows) - windows
    at = np.repeat(begin - first, windows) + np.arange(windows.sum())
    order, new = alike(words, at, window)
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(np.repeat(ids, windows)[order], starts)
    owner = np.empty(len(at), np.int64)
    owner[order] = np.repeat(least, np.diff(np.append(starts, len(at))))
    return owner, first


def _settled(rows: list[tuple], window: int) -> tuple[np.ndarray, ...]:
    """(id, key, span) of the windows of one range that also start under a smaller id; a span is its first window times 2 ** 20 plus the number of its windows."""
    ids, keys, starts = (np.concatenate([np.frombuffer(r[j], np.int64) for r in rows]) for j in range(3))
    windows = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows]).astype(np.int64)
    every = []
    for r in rows:
        blob, ends = r[4], np.cumsum(np.frombuffer(r[3], np.int32).astype(np.int64) + (window - 1)).tolist()
        every += [blob[lo:hi] for lo, hi in zip([0, *ends], ends)]
    number = {x: k for k, x in enumerate(dict.fromkeys(every))}
    of = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, ids)
    owner, first = least_ids(list(number), least, window)
    size = np.diff(np.append(first, len(owner)))
    low, high = np.minimum.reduceat(owner, first)[of], np.maximum.reduceat(owner, first)[of]
    all_, some = np.flatnonzero(high < ids), np.flatnonzero((low < ids) & (high >= ids))
    n = size[of[some]]
    row = np.repeat(some, n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hit = owner[first[of[row]] + at] < ids[row]
    row, at = row[hit], at[hit]
    if len(row):
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))))
        length = np.diff(np.append(new, len(row)))
        row, at = row[new], at[new]
    else:
        length = at
    who = np.concatenate((all_, row))
    return ids[who], keys[who], (np.concatenate((starts[all_], starts[row] + at)) << 20) | np.concatenate((windows[all_], length))


def _settle(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range; those of a run that other ranges share leave as they are, with the run's number."""
        now, held = None, []

        def settled():
            ids, keys, spans = _settled(held, window)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(spans), pa.nulls(len(ids), pa.int32())], ["_id", "_key", "span", "run"])

        for b in batches:
            for to, run, *row in zip(*(c.to_pylist() for c in b.columns)):
                if run >= 0:
                    starts = np.frombuffer(row[2], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[0], np.int64)), pa.array(np.frombuffer(row[1], np.int64)), pa.array((starts << 20) | 1), pa.array(np.full(len(starts), run, np.int32))], ["_id", "_key", "span", "run"])
                    continue
                if to != now and held:
                    yield settled()
                    held = []
                now = to
                held.append(row)
        if held:
            yield settled()

    return scan


def shared_suffixes(texts: DataFrame, window: int = WINDOW, k: int = ANCHOR, in_range: int = RANGE) -> DataFrame:
    """_id, _key, span: windows of each text that also start in one with a smaller id; see _settled. texts: _id, _key, _text, different rows different texts."""
    spark = texts.sparkSession
    total, least = texts.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(anchor_filter(texts, lambda batches: parts(batches, window, k), "suffix-repeated"))

    of = max(1, total // SAMPLE_TEXTS)
    sample = texts.where(F.pmod(F.xxhash64("_id", "_key"), F.lit(of)) == 0).transform(in_arrow, _sampled(window, k, sent), "stretch binary, at int, id long, n long").toArrow()
    stretches = list(zip(sample.column(0).to_pylist(), sample.column(2).to_pylist()))
    anchors = np.array([x[a : a + k] for (x, _), a in zip(stretches, sample.column(1).to_pylist())], f"S{k}")
    ranges = max(least, sum(sample.column(3).to_pylist()) * of // in_range)
    splitters = spark.sparkContext.broadcast(Splitters(anchors, stretches, window, k, ranges))

    dealt = texts.transform(in_arrow, _dealt(window, k, sent, splitters), "range int, run int, ids binary, keys binary, starts binary, windows binary, blob binary")
    ranges += len(splitters.value.windows) + 1
    found = dealt.repartitionById(min(ranges, 4 * least), F.pmod("range", F.lit(min(ranges, 4 * least)))).sortWithinPartitions("range", "run").transform(in_arrow, _settle(window), "_id long, _key long, span long, run int")
    found = materialize(found, "suffix-found")
    # equal windows on both sides of a boundary: fewer runs than splitters
    across = found.where("run is not null")
    owners = across.groupBy("run").agg(F.min("_id").alias("least"))
    settled = across.join(F.broadcast(owners), "run").where("_id > least")
    return found.where("run is null").select("_id", "_key", "span").unionByName(settled.select("_id", "_key", "span"))


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, in_range: int = RANGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Removes each byte covered by a run of `window` bytes that also starts in a document with a smaller id.
    Null texts are empty; texts shorter than a window lose nothing; a null id neither gives nor loses bytes. Rows
    that share an id are texts of their own, which take nothing from each other. Texts of any length are read
    whole. Other columns are ignored; an empty table gives an empty result.
    """
    thin, texts, copies = units(docs, id_col, text_col)
    found = materialize(shared_suffixes(texts, window, min(ANCHOR, max(1, window // 2)), in_range), "suffix-spans")
    masks = found.groupBy("_id", "_key").agg(F.collect_list("span").alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, spans, sha = [], [], [], []
            for t, got, copy in zip(b.column(1), b.column(2), b.column(3).to_pylist()):
                x = t.as_py()
                mask = None
                if copy and len(x) >= window:
                    mask = np.ones(len(x), bool)
                elif not copy and got.is_valid:
                    s = got.values.to_numpy()
                    mask = covered(len(x), s >> 20, (s >> 20) + (s & ((1 << 20) - 1)), window)
                n.append(len(x))
                gone.append(0 if mask is None else int(mask.sum()))
                spans.append(0 if mask is None else len(runs_of(mask)))
                sha.append(hashlib.sha256(x if mask is None else np.frombuffer(x, np.uint8)[~mask].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64()) for v in (n, gone, spans)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = copies(thin).join(masks, ["_id", "_key"], "left").select("_id", "_text", "spans", "copy")
    return rows.transform(in_arrow, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(n - 48, 1))) AS i, hx FROM w),
k AS (SELECT doc_id, i, substr(hx, 2 * i - 1, 100) AS key FROM s),
m AS (SELECT key, min(doc_id) AS lo FROM k GROUP BY key HAVING min(doc_id) < max(doc_id)),
h AS (SELECT k.doc_id, k.i FROM k JOIN m ON m.key = k.key WHERE k.doc_id > m.lo),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r),
c AS (SELECT doc_id, run, min(i) AS lo, max(i) + 49 AS hi FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM c),
f AS (SELECT e.doc_id, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, string_agg(substr(hx, 2 * before + 1, 2 * (lo - before - 1)), '' ORDER BY lo) || substr(any_value(hx), 2 * max(hi) + 1) AS kept
  FROM e JOIN w ON w.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT w.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256
FROM w LEFT JOIN f ON f.doc_id = w.doc_id
"""
