"""Long repeated spans of words by a compacted de Bruijn graph, and what is left without them.

Windows of 50 words are the edges of the graph, their overlaps of 49 words its nodes, both named by 64-bit hashes. Windows with one anchor
(see spans) come to one task; an edge is repeated if a text with a larger id has it too, and its source is its first
place under its smallest id. There, edges that follow each other without a branch are one piece. Pieces that meet in
a node without a branch compact into paths through joins. A text's places on a path are a long span, whose words
are read again in both texts, at the coordinates of the source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import BROADCAST_IDS, WordHashes, in_arrow, materialize, rolling
from dossier.llm.spans import HELD, Filter, Stretches, anchor_filter, covered, units

WINDOW, ANCHOR = 50, 16
#: Words of texts that are looked at together; a longer text is cut into parts that overlap by a window less one word.
PART = 1 << 16
#: Stretches that come to one task together, as the sample has it.
RANGE = 20_000
#: Texts and stretches of a text that the sample has, at most. It decides what is dealt by single windows, nothing else.
SAMPLE_TEXTS, SAMPLE_OF_TEXT = 2000, 500
#: Spans of one source text that are read in one row.
READ_AT_ONCE = 512


class Part(Stretches):
    """The stretches of some texts, and their words."""

    def __init__(self, texts: list[list[bytes]], hashes: WordHashes, window: int, k: int):
        self.words = [w for t in texts for w in t]
        self.tokens = hashes.of(self.words)
        super().__init__(rolling(self.tokens, k), np.array([len(t) for t in texts], np.int64), window, k)


def parts(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[tuple[Part, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """See spans.Parts."""
    hashes, texts, of, size, number = WordHashes(), [], [], 0, 0

    def made():
        return (Part(texts, hashes, window, k), *(np.array(x, np.int64) for x in zip(*of)))

    for b in batches:
        for i, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            words = t.as_py().split()
            number += 1
            for lo in range(0, len(words) - window + 1, PART):
                texts.append(words[lo : lo + PART + window - 1])
                of.append((number, i, key, lo))
                size += len(texts[-1])
                if size >= PART:
                    yield made()
                    texts, of, size = [], [], 0
    if texts:
        yield made()


def _sampled(window: int, k: int, sent):
    """Anchor and windows' hashes of stretches of a few texts; n: how many there were, in one row of each part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = Filter(*sent.value)
        for part, *_ in parts(batches, window, k):
            keep = np.flatnonzero(there(part.hash))
            pick = np.concatenate([own[:: -(-len(own) // SAMPLE_OF_TEXT)] for own in np.split(keep, np.flatnonzero(np.diff(part.owner[keep])) + 1) if len(own)] or [keep])
            whole = rolling(part.tokens, window)
            rows = [whole[f : f + n].tobytes() for f, n in zip(part.first[pick], part.windows[pick])]
            yield pa.RecordBatch.from_arrays([pa.array(part.hash[pick].view(np.int64)), pa.array(rows, pa.binary()), pa.array(([len(keep)] + [0] * len(rows))[: len(rows)], pa.int64())], ["anchor", "hashes", "n"])

    return scan


class Deal:
    """Where stretches go: by the hash of their anchor; those of hot anchors window by window, by the window's hash; windows that are hot themselves to any of several tasks."""

    def __init__(self, anchors: np.ndarray, hashes: list[np.ndarray], stretches: int, in_range: int, least: int):
        self.ranges = max(least, stretches // in_range)
        scale = max(1.0, stretches / max(1, len(anchors)))
        most = max(2, stretches / self.ranges / 4 / scale)
        values, counts = np.unique(anchors, return_counts=True)
        self.hot = values[counts > most]  # fewer than 4 times the ranges
        of = [h for a, h in zip(anchors, hashes) if self.is_hot(np.array([a]))[0]]
        values, counts = np.unique(np.concatenate(of) if of else np.empty(0, np.uint64), return_counts=True)
        self.runs = values[counts > most]

    def is_hot(self, anchors: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(anchors), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, anchors), len(self.hot) - 1)] == anchors

    def run_of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of a hot window, -1 for others."""
        if not len(self.runs):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.runs, hashes), len(self.runs) - 1)
        return np.where(self.runs[at] == hashes, at, -1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.ranges)).astype(np.int64)


def _dealt(window: int, k: int, sent, deal):
    """Stretches that may meet others, packed by range: ids, keys, first windows, numbers of windows, nodes at both ends, edges."""
    names = ["range", "run", "ids", "keys", "starts", "windows", "lefts", "rights", "edges"]

    def packed(held: list[tuple]) -> pa.RecordBatch:
        to, run, ids, keys, starts, windows, lefts, rights, edges = (np.concatenate([h[j] for h in held]) for j in range(9))
        order = np.lexsort((run, to))
        cut = np.flatnonzero(np.concatenate(([True], (to[order][1:] != to[order][:-1]) | (run[order][1:] != run[order][:-1]))))
        begin = np.cumsum(windows) - windows
        rows = []
        for o in np.split(order, cut[1:]):
            n = windows[o]
            at = np.repeat(begin[o] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows.append((int(to[o[0]]), int(run[o[0]]), *(x[o].tobytes() for x in (ids, keys, starts, windows, lefts, rights)), edges[at].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int32() if j < 2 else pa.binary()) for j in range(9)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, ranges = Filter(*sent.value), deal.value
        held, n = [], 0
        for part, _, ids, keys, lows in parts(batches, window, k):
            keep = np.flatnonzero(there(part.hash))
            if not len(keep):
                continue
            whole, nodes = rolling(part.tokens, window), rolling(part.tokens, window - 1)
            hot = ranges.is_hot(part.hash[keep])
            for own, single in ((keep[~hot], False), (keep[hot], True)):
                if not len(own):
                    continue
                first, windows, owner = part.first[own], part.windows[own], part.owner[own]
                if single:
                    owner = np.repeat(owner, windows)
                    first = np.repeat(first - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
                    windows = np.ones(len(first), np.int64)
                    run = ranges.run_of(whole[first])
                    to = np.where(run >= 0, ranges.of(whole[first] + ids[owner].view(np.uint64)), ranges.of(whole[first]))
                else:
                    to, run = ranges.of(part.hash[own]), np.full(len(first), -1)
                edges = whole[np.repeat(first - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())]
                held.append((to, run, ids[owner], keys[owner], first - part.bases[owner] + lows[owner], windows, nodes[first], nodes[first + windows], edges))
                n += len(edges) + 6 * len(first)
            if n >= HELD:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return scan


#: What a range yields: members (text's place, its source's place, the first edge of the source's piece) and pieces (n edges from a place of their source, nodes at their ends where other pieces may follow).
FOUND = "piece boolean, _id long, _key long, start long, n long, src_id long, src_key long, src_start long, at long, left long, right long, run int"


def _batch(piece, cols, run=None) -> pa.RecordBatch:
    n = len(cols[0])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, piece)), *(pa.nulls(n, pa.int64()) if c is None else c if isinstance(c, pa.Array) else pa.array(np.asarray(c, np.int64)) for c in cols), pa.nulls(n, pa.int32()) if run is None else pa.array(np.full(n, run, np.int32))], [c.split()[0] for c in FOUND.split(", ")])


def _graph(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Members and pieces of one range."""
    ids, keys, starts, windows, lefts, rights, edges = (np.concatenate([np.frombuffer(r[j], np.int64) for r in rows]) for j in range(7))
    names, edge = np.unique(edges, return_inverse=True)
    which = np.repeat(np.arange(len(ids)), windows)
    offset = np.arange(len(which)) - (np.cumsum(windows) - windows)[which]
    # the source of an edge: its first place under its smallest id
    order = np.lexsort((starts, keys, ids))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    source, largest = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
    np.minimum.at(source, edge, (rank[which] << 20) | offset)
    np.maximum.at(largest, edge, ids[which])
    src, src_offset = order[source >> 20], source & ((1 << 20) - 1)
    repeated = largest > ids[src]

    # edges that follow each other somewhere: without a branch if one has no other next and the other no other last one
    follow = np.flatnonzero((which[1:] == which[:-1]) & repeated[edge[1:]] & repeated[edge[:-1]])
    pairs = np.unique(edge[follow] * len(names) + edge[follow + 1])
    out, into = np.bincount(pairs // max(1, len(names)), minlength=len(names)), np.bincount(pairs % max(1, len(names)), minlength=len(names))
    own = np.flatnonzero(repeated[edge] & (src[edge] == which) & (src_offset[edge] == offset))
    if not len(own):
        return
    goes_on = (which[own][1:] == which[own][:-1]) & (offset[own][1:] == offset[own][:-1] + 1) & (out[edge[own[:-1]]] == 1) & (into[edge[own[1:]]] == 1)
    begins = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    count = np.diff(np.append(begins, len(own)))
    k, o = which[own[begins]], offset[own[begins]]
    place = starts[k] + o
    # within a stretch a piece ends at a branch or where its source does, and nothing goes on there
    left, right = pa.array(lefts[k], mask=o > 0), pa.array(rights[k], mask=o + count < windows[k])
    yield _batch(True, [ids[k], keys[k], place, count, None, None, None, None, left, right])
    piece_of = np.full(len(names), -1)
    piece_of[edge[own]] = np.repeat(np.arange(len(begins)), count)

    # members: every place of a repeated edge under a larger id than its source's
    at = np.flatnonzero(repeated[edge] & (ids[src[edge]] < ids[which]))
    if not len(at):
        return
    t, e = which[at], edge[at]
    there = starts[src[e]] + src_offset[e]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (at[1:] != at[:-1] + 1) | (piece_of[e][1:] != piece_of[e][:-1]) | (there[1:] != there[:-1] + 1)))
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    t, e, there, at = t[begin], e[begin], there[begin], at[begin]
    yield _batch(False, [ids[t], keys[t], starts[t] + offset[at], n, ids[src[e]], keys[src[e]], there, place[piece_of[e]], None, None])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range; hot windows leave as they are, with their number and nodes."""
    now, held = None, []
    for b in batches:
        for to, run, *row in zip(*(c.to_pylist() for c in b.columns)):
            if run >= 0:
                ids, keys, starts, windows, lefts, rights = (np.frombuffer(x, np.int64) for x in row[:6])
                yield _batch(False, [ids, keys, starts, windows, None, None, None, None, lefts, rights], run)
                continue
            if to != now and held:
                yield from _graph(held)
                held = []
            now = to
            held.append(row)
    if held:
        yield from _graph(held)


def _paths(pieces: DataFrame) -> DataFrame:
    """_id, _key, start, head: the first piece of each piece's path. pieces: _id, _key, start, n, left, right.

    A piece goes on from the one before it, at the same source, where both meet in a node that no other piece enters or leaves: two joins
    on nodes find such pieces. A path is then a run of them in their source, which bounds it.
    """
    one = lambda side: pieces.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("node")).agg(F.count("*").alias("k")).where("k = 1").select("node")
    simple = one("left").join(one("right"), "node")
    before = pieces.select("_id", "_key", (F.col("start") + F.col("n")).alias("start"), F.col("right").alias("node")).join(simple, "node")
    links = before.join(pieces.select("_id", "_key", "start", F.col("left").alias("node")), ["_id", "_key", "start", "node"]).select("_id", "_key", "start", F.lit(True).alias("goes_on"))
    at = pieces.select("_id", "_key", "start").join(links, ["_id", "_key", "start"], "left")
    upto = Window.partitionBy("_id", "_key").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return at.select("_id", "_key", "start", F.max(F.when(F.col("goes_on").isNull(), F.col("start"))).over(upto).alias("head"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long spans of each text (_id, _key, places): places that follow each other on one path, on both sides."""
    for b in batches:
        out = []
        for i, key, places in zip(*(c.to_pylist() for c in b.columns)):
            last = None
            for p in sorted(places, key=lambda p: (p["start"], p["n"])):
                of = (p["src_id"], p["src_key"], p["head"], p["start"] - p["src_start"])
                if last is not None and last[0] == of and last[1] + last[2] == p["start"]:
                    last[2] += p["n"]
                    continue
                if last is not None:
                    out.append((i, key, last[1], last[2], *last[0][:2], last[1] - last[0][3]))
                last = [of, p["start"], p["n"]]
            out.append((i, key, last[1], last[2], *last[0][:2], last[1] - last[0][3]))
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(7)], ["_id", "_key", "start", "n", "src_id", "src_key", "src_start"])


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def repeated_spans(texts: DataFrame, window: int = WINDOW, k: int = ANCHOR, in_range: int = RANGE) -> DataFrame:
    """_id, _key, start, n, said: n windows from a place of a text that all start in its source too, a text with a smaller id; said is a digest of the source's words there.

    texts: _id, _key, _text, different rows different texts.
    """
    spark = texts.sparkSession
    total, least = texts.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(anchor_filter(texts, lambda batches: parts(batches, window, k), "spans-repeated"))
    of = max(1, total // SAMPLE_TEXTS)
    sample = texts.where(F.pmod(F.xxhash64("_id", "_key"), F.lit(of)) == 0).transform(in_arrow, _sampled(window, k, sent), "anchor long, hashes binary, n long").toArrow()
    anchors = np.array(sample.column(0).to_pylist(), np.int64).view(np.uint64)
    deal = Deal(anchors, [np.frombuffer(x, np.uint64) for x in sample.column(1).to_pylist()], sum(sample.column(2).to_pylist()) * of, in_range, least)
    sent_deal = spark.sparkContext.broadcast(deal)

    tasks = min(deal.ranges, 4 * least)
    dealt = texts.transform(in_arrow, _dealt(window, k, sent, sent_deal), "range int, run int, ids binary, keys binary, starts binary, windows binary, lefts binary, rights binary, edges binary")
    found = materialize(dealt.repartitionById(tasks, F.pmod("range", F.lit(tasks))).sortWithinPartitions("range", "run").transform(in_arrow, _settle, FOUND), "spans-found")
    members = found.where("not piece and run is null").select("_id", "_key", "start", "n", "src_id", "src_key", "src_start", "at")
    pieces = found.where("piece").select("_id", "_key", "start", "n", "left", "right")
    if len(deal.runs):
        hot = found.where("run is not null")
        source = hot.groupBy("run").agg(F.min(F.struct("_id", "_key", "start")).alias("s"), F.max("_id").alias("last"), F.first("left").alias("left"), F.first("right").alias("right")).where("last > s._id")  # a row for each hot window
        source = materialize(source, "spans-hot")
        pieces = pieces.unionByName(source.select("s._id", "s._key", "s.start", F.lit(1).cast("long").alias("n"), "left", "right"))
        also = hot.select("_id", "_key", "start", "n", "run").join(F.broadcast(source.select("run", "s")), "run").where("_id > s._id")
        members = members.unionByName(also.select("_id", "_key", "start", "n", F.col("s._id").alias("src_id"), F.col("s._key").alias("src_key"), F.col("s.start").alias("src_start"), F.col("s.start").alias("at")))
    heads = materialize(_paths(materialize(pieces, "spans-pieces")), "spans-heads")
    heads = heads.select(F.col("_id").alias("src_id"), F.col("_key").alias("src_key"), F.col("start").alias("at"), "head")
    placed = members.join(F.broadcast(heads) if heads.count() <= BROADCAST_IDS else heads, ["src_id", "src_key", "at"])
    lists = placed.groupBy("_id", "_key").agg(F.collect_list(F.struct("start", "n", "src_id", "src_key", "src_start", "head")).alias("places"))  # a text bounds its places
    spans = materialize(lists.transform(in_arrow, _merged, "_id long, _key long, start long, n long, src_id long, src_key long, src_start long"), "spans-long")

    # each source is read where spans refer to it, so many of its spans in a row
    asked = spans.select(F.col("src_id").alias("_id"), F.col("src_key").alias("_key"), F.col("src_start").alias("start"), "n").distinct()
    counts = asked.groupBy("_id", "_key").agg(F.ceil(F.count("*") / READ_AT_ONCE).alias("rows"))
    asked = asked.join(counts, ["_id", "_key"]).withColumn("row", F.pmod(F.xxhash64("start", "n"), "rows"))
    asked = materialize(asked.groupBy("_id", "_key", "row").agg(F.collect_list(F.struct("start", "n")).alias("asked")), "spans-asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, key, places, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                words = t.as_py().split()
                out += [(i, key, p["start"], p["n"], _digest(words[p["start"] : p["start"] + p["n"] + window - 1])) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64() if j < 4 else pa.binary()) for j in range(5)], ["src_id", "src_key", "src_start", "n", "said"])

    sources = asked.select("_id", "_key").distinct()
    of_sources = texts.join(F.broadcast(sources) if sources.count() <= BROADCAST_IDS else sources, ["_id", "_key"], "left_semi")  # few texts are sources
    said = asked.join(of_sources, ["_id", "_key"]).select("_id", "_key", "asked", "_text").transform(in_arrow, read, "src_id long, src_key long, src_start long, n long, said binary")
    return spans.join(said, ["src_id", "src_key", "src_start", "n"]).select("_id", "_key", "start", "n", "said")


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, in_range: int = RANGE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.

    Removes each word covered by a run of `window` words that also starts in a document with a smaller id.
    Null texts have no words; texts of fewer than `window` words lose none; a null id neither gives nor loses words. Rows
    that share an id are texts of their own, which take nothing from each other; repeated rows get the same answer. Texts of any
    length are read whole. Other columns are ignored; an empty table gives an empty result. A span whose words are not
    those of its source raises: two different runs of words with one 64-bit hash.
    """
    thin, texts, copies = units(docs, id_col, text_col)
    found = materialize(repeated_spans(texts, window, min(ANCHOR, max(1, window // 2)), in_range), "spans-said")
    masks = found.groupBy("_id", "_key").agg(F.collect_list(F.struct("start", "n", "said")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            for i, t, spans, copy in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                w = t.as_py().split()
                mask = np.zeros(len(w), bool)
                if copy and len(w) >= window:
                    mask[:] = True
                elif not copy and spans:
                    for p in spans:
                        if _digest(w[p["start"] : p["start"] + p["n"] + window - 1]) != p["said"]:
                            raise ValueError(f"a span of document {i} differs from its source")
                    mask = covered(len(w), [p["start"] for p in spans], [p["start"] + p["n"] for p in spans], window)
                n.append(len(w))
                gone.append(int(mask.sum()))
                sha.append(hashlib.sha256(b" ".join([w[j] for j in np.flatnonzero(~mask)] if gone[-1] else w)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = copies(thin).join(masks, ["_id", "_key"], "left").select("_id", "_text", "spans", "copy")
    return rows.transform(in_arrow, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 48, 1))) AS i, ws FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS key FROM s),
m AS (SELECT key, min(doc_id) AS lo FROM k GROUP BY key HAVING count(*) > 1),
h AS (SELECT k.doc_id, list(k.i) AS starts FROM k JOIN m ON m.key = k.key WHERE k.doc_id > m.lo GROUP BY k.doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 50)))) AS gone FROM h),
r AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_select(ws, list_sort(list_filter(range(1, len(ws) + 1), lambda j: NOT list_contains(gone, j)))), ' ') END AS kept
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM r
"""
