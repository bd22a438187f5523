"""Exact Jaccard join of word-shingle sets by partitioning the shingle universe.

Shingles are hashed into the segments of a size band. Two sets of a linked pair differ in at most H
shingles, so at most H of a set's segments differ in content. A set therefore indexes H + 1 of its
non-empty segments, in one order that all sets share: under it, the first segment that both have alike
is among the indexed ones of both. The order is what a cost model allocates: segments whose content
is frequent in the whole corpus come last, so shared passages are indexed only by sets that have little
else. A set with too few segments indexes all of them and their one-deletion neighbourhoods, which
count for two differences each. Sets that meet in a segment are verified exactly.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import WordHashes, in_arrow, lower_ascii_bytes, materialize, mix, only, rolling
from dossier.llm.components import components

WORDS, PERCENT = 5, 80
#: Cells of the table of segment frequencies, at least and at most: a power of two, about one for each two rows. The most bounds what a task counts and the driver gets; a bit for each is sent.
CELLS, MOST_CELLS = 1 << 19, 1 << 24
#: Members that each bucket is compared with, before all its pairs that are still apart.
HUBS = 3
#: Least bits of a set's parity sketch; larger sets have the next power of two above their size. Sketches
#: differ in no more bits than sets in shingles, so they rule pairs out exactly.
SKETCH = 1024
#: Members of a bucket that are compared in one piece of work.
BLOCK = 2048
_SLICES = 16
_SEED = np.uint64(0x5851F42D4C957F2D)
HOT_SHARE = 0.001


def shingles(words: list[bytes], hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the runs of k words; of all words where there are fewer."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    if n >= k:
        return np.unique(rolling(h, k))
    return mix(rolling(h, n) ^ np.uint64(n))


def shingle_set(text: bytes | None, k: int = WORDS) -> set:
    """The shingles themselves."""
    w = lower_ascii_bytes(text or b"").split()
    return set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()


def sketch(sh: np.ndarray) -> bytes:
    bits = max(SKETCH, 1 << (len(sh) - 1).bit_length()) if len(sh) else SKETCH
    return np.packbits(np.bincount((sh & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """(n, words) the sketches, larger ones folded to size bytes: halves of a parity sketch add up to the sketch of half its bits."""
    out = np.empty((len(sketches), size), np.uint8)
    for j, s in enumerate(sketches):
        out[j] = np.frombuffer(s, np.uint8) if len(s) == size else np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, size), axis=0)
    return out.view(np.uint64)


def schemes(size: int, percent: int) -> Iterator[tuple[int, int]]:
    """(band, most differences) under which a set of this size is indexed: its own band, and the one below if a partner can be there."""
    part, whole = 100 - percent, 100 + percent
    band = size.bit_length() - 1
    yield band, (size + 100 * size // percent) * part // whole
    below = (1 << band) - 1
    if band and 100 * below >= percent * size:
        yield band - 1, (size + below) * part // whole


def segments(band: int) -> int:
    return max(4, (9 << band) // 10)


def _content(sh: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each group, its start, shingle values in segment order, sum of each group)."""
    x = mix(sh ^ _SEED)
    seg = ((x >> np.uint64(32)) % np.uint64(segments(band))).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg, x = seg[order], x[order]
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    return seg[starts], starts, x, np.add.reduceat(x, starts)


def _name(sums: np.ndarray, seg: np.ndarray, band: int, space: int) -> np.ndarray:
    return mix(sums ^ mix(seg.astype(np.uint64) + np.uint64((band << 34) + (space << 33) + 1)))


def signatures(sh: np.ndarray, percent: int, heavy: np.ndarray | None) -> list[np.ndarray]:
    """What a set is indexed under; with heavy None, all its segments' signatures, to be counted."""
    out = []
    for band, most in schemes(len(sh), percent):
        seg, starts, x, sums = _content(sh, band)
        sig = _name(sums, seg, band, 0)
        if heavy is None:
            out.append(sig)
        elif len(sig) > most:
            late = heavy[(sig >> np.uint64(32)).astype(np.int64) & (len(heavy) - 1)]
            light = sig[~late]
            if len(light) > most:
                out.append(np.partition(light, most)[: most + 1])
            else:
                out += [light, np.sort(sig[late])[: most + 1 - len(light)]]
        else:
            sizes = np.diff(np.append(starts, len(x)))
            out += [sig, _name(sums, seg, band, 1)]
            long = np.repeat(sizes > 1, sizes)
            out.append(_name((np.repeat(sums, sizes) - x)[long], np.repeat(seg, sizes)[long], band, 1))
            if 2 * (sizes > 1).sum() + (sizes == 1).sum() <= most:
                out.append(mix(np.array([(band << 1) + 1], np.uint64) ^ _SEED))  # too few segments even so: such sets meet here
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, np.ndarray, bytes, bool]]:
    """(id, shingles, digest of the words, first of these words in this partition) of each row of (_id, _text)."""
    import xxhash

    hashes, seen = WordHashes(), set()
    for b in batches:
        ids = b.column(0).to_pylist()
        for i, t in enumerate(b.column(1)):
            words = lower_ascii_bytes(t.as_py() or b"").split()
            digest = xxhash.xxh3_128_digest(b" ".join(words))
            first = digest not in seen and bool(words) and ids[i] is not None
            if first:
                seen.add(digest)
            yield ids[i], shingles(words, hashes, k), digest, first


def _scan(k: int, percent: int, cells: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "n", "key", "sketch", "slice", "counts"]
        counts = np.zeros(cells, np.int64)

        def rows(held):
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.binary()), pa.array([h[3] for h in held], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)

        held, met, waiting = [], [], 0
        for i, sh, digest, first in _sets(batches, k):
            held.append((i, len(sh), digest, sketch(sh) if first else None))
            if first:
                for sig in signatures(sh, percent, None):
                    met.append(sig)
                    waiting += len(sig)
            if waiting > 1_000_000:
                counts += np.bincount((np.concatenate(met) >> np.uint64(32)).astype(np.int64) & (cells - 1), minlength=cells)
                met, waiting = [], 0
            if len(held) >= 20_000:
                yield rows(held)
                held = []
        yield rows(held)
        if met:
            counts += np.bincount((np.concatenate(met) >> np.uint64(32)).astype(np.int64) & (cells - 1), minlength=cells)
        parts = counts.reshape(_SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.nulls(_SLICES, pa.int64()), pa.nulls(_SLICES, pa.int64()), pa.nulls(_SLICES, pa.binary()), pa.nulls(_SLICES, pa.binary()), pa.array(range(_SLICES), pa.int32()), pa.array([zlib.compress(p.astype(np.uint32).tobytes(), 1) for p in parts], pa.binary())], names)

    return scan


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the slices of frequency tables as they stream by."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held[k] = held.get(k, 0) + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["slice", "counts"])


def heavy_cells(tables: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Which cells of the frequency table stand out. So many numbers reach the driver, MOST_CELLS whatever the input."""
    counts = np.zeros((_SLICES, cells // _SLICES), np.int64)
    for k, x in tables.repartition(_SLICES, "slice").transform(in_arrow, _added, "slice int, counts binary").collect():
        counts[k] += np.frombuffer(bytes(x), np.int64)
    counts = counts.reshape(-1)
    usual = float(np.median(counts))
    return counts > 1.25 * usual + 8 * usual**0.5 + 8


def _index(k: int, percent: int, heavy: np.ndarray):
    packed = np.packbits(heavy).tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        sigs, ids, sizes, counts, held = [], [], [], [], 0

        def rows():
            per = np.array(counts, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), per)), pa.array(np.repeat(np.array(sizes, np.int64), per))], ["sig", "_id", "n"])

        for i, sh, _, first in _sets(batches, k):
            if not first:
                continue
            own = signatures(sh, percent, late)
            n = sum(map(len, own))
            sigs += own
            ids.append(i)
            sizes.append(len(sh))
            counts.append(n)
            held += n
            if held >= 200_000:
                yield rows()
                sigs, ids, sizes, counts, held = [], [], [], [], 0
        if held:
            yield rows()

    return scan


def _near(percent: int):
    """Keeps pairs (u, v, nu, nv, su, sv) whose sketches allow a link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            differ = np.zeros(b.num_rows, np.int64)
            sizes = np.array([min(len(p), len(q)) for p, q in zip(x, y)], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                differ[at] = np.bitwise_count(folded([x[j] for j in at], size) ^ folded([y[j] for j in at], size)).sum(axis=1, dtype=np.int64)
            both = b.column(2).to_numpy() + b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(differ * (100 + percent) <= both * (100 - percent)))

    return scan


def _apart(percent: int):
    """Pairs of each group (sig, lo, hi) of rows (sig, lo, hi, block, rep, n, c, s) that are in different components and whose sizes and sketches allow a link."""

    def of(group: list[tuple]) -> Iterator[tuple[int, int]]:
        lo, hi = group[0][1], group[0][2]
        left, right = [r for r in group if r[3] == lo], [r for r in group if r[3] == hi]
        kinds = {len(r[7]) for r in group}
        for p in kinds:
            for q in kinds:
                x, y = [r for r in left if len(r[7]) == p], [r for r in right if len(r[7]) == q]
                if not x or not y or (lo == hi and p > q):
                    continue
                a, b = folded([r[7] for r in x], min(p, q)), folded([r[7] for r in y], min(p, q))
                n, c, rep = (np.array([r[j] for r in y], np.int64) for j in (5, 6, 4))
                for j, r in enumerate(x):
                    differ = np.bitwise_count(b ^ a[j]).sum(axis=1, dtype=np.int64)
                    fits = (differ * (100 + percent) <= (n + r[5]) * (100 - percent)) & (c != r[6]) & (100 * np.minimum(n, r[5]) >= percent * np.maximum(n, r[5]))
                    for v in rep[fits]:
                        yield min(r[4], int(v)), max(r[4], int(v))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], set()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for r in itertools.chain(rows, [None]):
            if group and (r is None or r[:3] != group[0][:3]):
                out.update(of(group))
                group = []
                if len(out) > 100_000 or r is None:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])
                    out = set()
            group.append(r)

    return scan


def _verify(k: int, percent: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, set] = {}

        def of(i, text):
            if i not in kept:
                if len(kept) >= 32:
                    kept.clear()
                kept[i] = shingle_set(text, k)
            return kept[i]

        for b in batches:
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = []
            for j in range(b.num_rows):
                x, y = of(u[j], b.column(2)[j].as_py()), shingle_set(b.column(3)[j].as_py(), k)
                both = len(x & y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return scan


def _by_key(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with classes (key, size, ...): the few large classes by broadcast, the others by their key."""
    is_hot = F.col("size") > F.lit(max(1, total * HOT_SHARE))
    hot = F.broadcast(classes.where(is_hot))  # fewer than 1 / HOT_SHARE
    few = rows.join(hot, key)
    rest = rows.join(F.broadcast(classes.where(is_hot).select(key)), key, "left_anti").join(classes.where(~is_hot), key)
    return few.unionByName(rest)


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; component_id
    is the smallest doc_id that links reach. A null or wordless text has an empty set and links with
    nothing; a row without id links with nothing and has a null component. Rows that share an id are one
    document. Other columns are ignored; an empty table gives an empty result. ids are long.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    cells = min(MOST_CELLS, max(CELLS, 1 << (docs.count() // 2).bit_length()))
    first = materialize(thin.transform(in_arrow, _scan(k, percent, cells), "_id long, n long, key binary, sketch binary, slice int, counts binary"), "join-sets")
    rows = first.where("slice is null").select("_id", "n", "key")
    total = rows.count()
    heavy = heavy_cells(first.where("slice is not null").select("slice", "counts"), cells)

    named = rows.where("_id is not null and n > 0")
    classes = named.groupBy("key").agg(F.min("_id").alias("rep"), F.count("*").alias("size"))
    members = materialize(_by_key(named, classes, "key", total).select("_id", "rep", "n"), "join-members")
    own = members.groupBy("_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v").select("u", "v")  # an id with several texts

    met = Window.partitionBy("sig")
    sigs = thin.transform(in_arrow, _index(k, percent, heavy), "sig long, _id long, n long")
    multi = sigs.withColumn("lo", F.min("_id").over(met)).withColumn("hi", F.max("_id").over(met)).where("lo < hi").select("sig", "_id", "n")
    multi = materialize(multi, "join-met")
    reps = multi.join(members.where("_id <> rep").select("_id", "rep").distinct(), "_id", "left").select("sig", F.coalesce("rep", "_id").alias("rep"), "n").distinct()
    buckets = reps.withColumn("lo", F.min("rep").over(met)).withColumn("hi", F.max("rep").over(met)).where("lo < hi").select("sig", "rep", "n")
    buckets = materialize(buckets, "join-buckets")
    asked = buckets.select(F.col("rep").alias("_id")).distinct()
    # a class's first row in some partition has its sketch
    sketches = first.where("sketch is not null").join(members.select("_id", "rep", "n").distinct(), ["_id", "n"]).join(asked.withColumnRenamed("_id", "rep"), "rep", "left_semi")
    sketches = materialize(sketches.groupBy("rep").agg(F.min("sketch").alias("s")), "join-sketches")
    fits = F.expr(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketches.select(F.col("rep").alias("u"), F.col("s").alias("su")), "u").join(sketches.select(F.col("rep").alias("v"), F.col("s").alias("sv")), "v")
        return both.select("u", "v", "nu", "nv", "su", "sv").transform(in_arrow, _near(percent), "u long, v long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of pairs (u, v), each once, that link by their texts."""
        pairs = materialize(pairs, "join-near")
        texts = materialize(only(thin, pairs.select(F.col("u").alias("_id")).union(pairs.select(F.col("v").alias("_id"))), "_id"), "join-texts")
        both = pairs.join(texts.select(F.col("_id").alias("v"), F.col("_text").alias("tv")), "v").join(texts.select(F.col("_id").alias("u"), F.col("_text").alias("tu")), "u")
        return materialize(both.select("u", "v", "tu", "tv").transform(in_arrow, _verify(k, percent), "u long, v long"), "join-links")

    def ordered(pairs: DataFrame) -> DataFrame:
        low = F.col("u") < F.col("v")
        return pairs.select(F.least("u", "v").alias("u"), F.when(low, F.col("nu")).otherwise(F.col("nv")).alias("nu"), F.greatest("u", "v").alias("v"), F.when(low, F.col("nv")).otherwise(F.col("nu")).alias("nv")).distinct()

    # some members of each bucket against the others
    hubs = [F.min(F.struct(F.xxhash64("rep", F.lit(j)).alias("order") if j else F.lit(0).cast("long").alias("order"), F.col("rep").alias("u"), F.col("n").alias("nu"))).over(met) for j in range(HUBS)]
    stars = buckets.withColumn("hubs", F.array(*hubs)).withColumn("hub", F.explode("hubs")).select("hub.u", "hub.nu", F.col("rep").alias("v"), F.col("n").alias("nv"))
    stars = materialize(ordered(stars.where((F.col("u") != F.col("v")) & fits)), "join-stars")
    links = own.unionByName(verified(near(stars)))
    found = components(links)
    # then all that are still apart, in blocks of a bounded size that are compared by sketches where they meet
    at = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", "n", F.coalesce("component", "rep").alias("c"))
    at = at.withColumn("c0", F.min("c").over(met)).withColumn("c1", F.max("c").over(met)).withColumn("k", F.count("*").over(met)).where("c0 < c1")
    at = at.join(sketches, "rep").withColumn("g", F.ceil(F.col("k") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), "g"))
    at = at.withColumn("other", F.explode(F.expr("sequence(0L, g - 1)"))).select("sig", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "n", "c", "s")
    apart = at.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").transform(in_arrow, _apart(percent), "u long, v long").distinct()
    more = verified(apart.join(stars.select("u", "v"), ["u", "v"], "left_anti"))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # rows of large classes and components meet their one row by broadcast or a split join, on thin rows
    to = members.select(F.col("_id").alias("doc_id"), "rep").distinct().join(found.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return rows.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles")).join(to, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS met FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.u, p.v FROM p JOIN n x ON x.doc_id = p.u JOIN n y ON y.doc_id = p.v WHERE 100 * met >= 80 * (x.n + y.n - met)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.a = w.doc_id
"""
