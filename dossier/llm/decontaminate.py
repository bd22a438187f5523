"""Benchmark decontamination: CGK embedding, sampled by runs of its steps, exact edit distance.

The CGK random walk (Chakraborty, Goldenberg, Koucky 2016) reads a string with one pointer that
moves on or stays by a random bit of (step, character). Where a fifth of the characters is edited, the walks of a whole
item and its copy soon fall out of step, so an item has a window at each of its characters, of as many steps as keep the
stated recall: one walk over a document meets them all, each at the steps that its item's length allows.
Windows that meet are counted (q-grams in common), then searched by Myers' bit vectors.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import islice, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.llm.common import in_arrow, lower_ascii_bytes, mix

#: A document that has a part within this share of an item's characters, in edits, is contaminated.
EDIT_PERCENT = 20
#: Share of leaks with EDIT_PERCENT edits at random places that the windows must meet; it sets their lengths.
RECALL = 0.98
#: Characters that windows may span on average, two steps for each; every so many characters of a document start one.
SPANS, STRIDE = (5, 6, 7, 8, 9, 10, 11, 12), 2
#: Bytes of benchmark text that are sent to the tasks at once; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that walk together; tables of some 40 bytes for each stand in a worker's memory meanwhile.
PART_BYTES = 512 << 10
#: Bits of patterns that are searched for side by side, and steps whose bits are kept until scores are counted.
_SIDE_BITS, _SIDE_STEPS = 2048, 4096
#: Windows that walk at once, and bits of a q-gram's code.
_CHUNK, _GRAM_BITS = 1 << 15, 15
#: Base of the codes of runs of characters, and its square.
_BASE, _BASE_2 = np.uint64(0x100000001B3), np.uint64(0x100000001B3**2 % (1 << 64))
#: What the table of cells says: that items have a window of this code, that longer windows of items begin with it.
_ENDS, _GOES_ON = 1, 2


def normalise(text: bytes | None) -> bytes:
    """The words of the A-Z lower-cased text joined by one space."""
    return b" ".join(lower_ascii_bytes(text or b"").split())


def edit_distance(pattern: bytes, text: bytes) -> int:
    """Edits between pattern and the nearest part of text (Myers' bit-vector search, whole pattern in one integer)."""
    m = len(pattern)
    if not m:
        return 0
    at = [0] * 256
    for j, c in enumerate(pattern):
        at[c] |= 1 << j
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = at[c]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full ^ (xv | ph))
        mv = ph & xv
    return best


def edit_distances(pairs: list[tuple[bytes, bytes]]) -> list[int]:
    """edit_distance of each (pattern, text). Short patterns search in the same integers, side by side with a bit free between them."""
    out = [0] * len(pairs)
    rest = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))  # texts of like lengths end together
    while rest:
        part, width = [], 0
        while rest and (not part or width + len(pairs[rest[-1]][0]) < _SIDE_BITS):
            part.append(rest.pop())
            width += len(pairs[part[-1]][0]) + 1
        if len(part) == 1:
            out[part[0]] = edit_distance(*pairs[part[0]])
            continue
        full, base, reads, tops = 0, 0, [], []
        for i in part:
            pattern, text = pairs[i]
            at = [0] * 256
            for j, c in enumerate(pattern, base):
                at[c] |= 1 << j
            reads.append(map(at.__getitem__, text))
            full |= ((1 << len(pattern)) - 1) << base
            tops.append(base + len(pattern) - 1)
            base += len(pattern) + 1
        pv, mv, size = full, 0, -(-base // 8)
        score, best = [len(pairs[i][0]) for i in part], [len(pairs[i][0]) for i in part]
        steps, done = map(sum, zip_longest(*reads, fillvalue=0)), 0
        while True:
            up, down = [], []
            for eq in islice(steps, _SIDE_STEPS):
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph = mv | (full ^ ((xh | pv) & full))
                mh = pv & xh
                up.append(ph.to_bytes(size, "little"))
                down.append(mh.to_bytes(size, "little"))
                ph = (ph << 1) & full
                pv = ((mh << 1) & full) | (full ^ (xv | ph))
                mv = ph & xv
            if not up:
                break
            ups, downs = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, size) for x in (up, down))
            for n, i in enumerate(part):
                own, byte, bit = slice(0, max(0, len(pairs[i][1]) - done)), tops[n] >> 3, tops[n] & 7
                if pairs[i][0] and pairs[i][1][done:]:
                    scores = score[n] + np.cumsum((ups[own, byte] >> bit & 1).astype(np.int64) - (downs[own, byte] >> bit & 1))
                    score[n], best[n] = int(scores[-1]), min(best[n], int(scores.min()))
            done += len(up)
        for n, i in enumerate(part):
            out[i] = best[n]
    return out


def window_of(m: int, percent: int) -> tuple[bool, int]:
    """(whether windows are exact pieces, characters they span) of an item of m characters.

    k edits leave one of k + 1 pieces whole, so pieces miss nothing; a longer span is taken where one of the k + 1 runs
    between edits at random places is that long with probability RECALL.
    """
    k = m * percent // 100
    piece = min(m // (k + 1), SPANS[-1])
    span = max((n for n in SPANS if (1 - (1 - percent / 100) ** n) ** (k + 1) <= 1 - RECALL), default=0)
    return (True, piece) if piece >= span else (False, span)


def common_grams(m: int, percent: int, exact: bool) -> tuple[int, int]:
    """(q, q-grams that a part within percent edits has in common with an item of m characters, at least).

    An edit breaks q of them. Items in pieces rely on that alone; for others, edits at random places leave
    (1 - percent / 100) ** q of them, here less 1.2 roots of m (over two standard deviations, by simulation).
    """
    k = m * percent // 100
    if exact:
        return 3, m - 2 - 3 * k
    return 6, max(m - 5 - 6 * k, int((m - 5) * (1 - percent / 100) ** 6 - 1.2 * m**0.5))


class Walks:
    """The random bits of the walk; the same everywhere."""

    def __init__(self, steps: int = 2 * SPANS[-1], seed: int = 11):
        self.bits, self.steps = np.random.default_rng(seed).integers(0, 2, (steps, 256)).astype(np.int64), steps

    @cached_property
    def twos(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of two steps at once, by the pair of characters there: what they add to the code, how far they move. Made in the task, not sent to it."""
        first, second, out = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8, []
        for step in range(0, self.steps, 2):
            moved = self.bits[step].take(first)
            read = np.where(moved, second, first)
            out.append((first.astype(np.uint64) * _BASE + read.astype(np.uint64), (moved + self.bits[step + 1].take(read)).astype(np.int8)))
        return out

    def go(self, pairs: np.ndarray, at: np.ndarray, h: np.ndarray, exact: bool, steps: range) -> tuple[np.ndarray, np.ndarray]:
        """(places, codes) after these steps, an even number of them unless exact; h is written on."""
        if exact:
            for _ in steps:
                h *= _BASE
                h += (pairs.take(at, mode="clip") & 255).view(np.uint64)
                at = at + 1
            return at, h
        for step in steps[::2]:
            pair = pairs.take(at, mode="clip")
            h *= _BASE_2
            add, move = self.twos[step // 2]
            h += add.take(pair, mode="clip")
            at = at + move.take(pair, mode="clip")
        return at, h

    def last(self, pairs: np.ndarray, at: np.ndarray, exact: bool, steps: range) -> np.ndarray:
        """Place of the last character that these steps read."""
        if exact:
            return at + len(steps) - 1
        at, _ = self.go(pairs, at, np.ones(len(at), np.uint64), exact, steps[:-2])
        return at + self.bits[steps[-2]].take(pairs.take(at) & 255)


def _start(n: int, exact: bool) -> np.ndarray:
    """The codes of n windows before their first step."""
    return np.full(n, 1 + exact, np.uint64)


def _pairs(data: np.ndarray) -> np.ndarray:
    """Each character and its next one."""
    pairs = data.copy()
    pairs[:-1] += data[1:] << 8
    return pairs


def _steps(done: int, span: int, exact: bool) -> range:
    """The steps of windows that span so many characters, after those that span `done`."""
    return range(done, span) if exact else range(2 * done, 2 * span)


def _key(codes: np.ndarray, span: int) -> np.ndarray:
    return mix(codes * np.uint64(64) + np.uint64(span))


def _cell(codes: np.ndarray, span: int, bits: int) -> np.ndarray:
    """A quick hash of bits bits, for the table of codes that items have."""
    return ((codes + np.uint64(span * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """Code of the q bytes from each place; data: int64."""
    out = np.empty(max(0, len(data) - q + 1), np.int64)
    for lo in range(0, len(out), _CHUNK):  # in parts that a core's cache holds
        n = min(_CHUNK, len(out) - lo)
        h = data[lo : lo + n].astype(np.uint64)
        for j in range(lo + 1, lo + q):
            h *= _BASE
            h += data[j : j + n].view(np.uint64)
        out[lo : lo + n] = mix(h) >> np.uint64(64 - _GRAM_BITS)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """The values of x (none negative), ascending; np.unique hashes them, which takes several times as long."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) > 0]


def _buffer(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)


class Items:
    """The windows of a block of benchmark items, and the q-grams of each item."""

    def __init__(self, items: list[tuple[int, bytes]], walks: Walks, percent: int = EDIT_PERCENT):
        self.walks, self.texts = walks, [(i, normalise(raw)) for i, raw in items]
        self.grams: list[Counter] = []
        self.spans: dict[bool, list[int]] = {True: [], False: []}
        pad = bytes(walks.steps)
        of: dict[tuple[bool, int], list[int]] = defaultdict(list)
        # a bit for each item that has a q-gram's code, 64 items in a row, and how often items have it where they aren't many
        self.bits_of = np.zeros((-(-len(items) // 64), 1 << _GRAM_BITS), np.uint64)
        self.packed = len(items) > 4000
        self.sets = np.zeros((0 if self.packed else len(items), 1 << _GRAM_BITS), np.uint8)
        lengths = np.array([len(t) for _, t in self.texts], np.int64)
        self.slack, self.length, self.q, self.least, self.different = lengths * percent // 100 + 8, lengths, lengths * 0, lengths * 0, lengths * 0
        for k, (_, text) in enumerate(self.texts):
            if not text:
                self.grams.append(Counter())
            else:
                kind = window_of(len(text), percent)
                of[kind].append(k)
                self.q[k], self.least[k] = common_grams(len(text), percent, kind[0])
                there = np.bincount(_grams(_buffer([text]), int(self.q[k])), minlength=1 << _GRAM_BITS)
                # of so many q-grams, those that repeat others may be in common without another code
                self.different[k] = self.least[k] - int(there.sum()) + np.count_nonzero(there)
                self.bits_of[k >> 6, there > 0] |= np.uint64(1 << (k & 63))
                self.grams.append(Counter(text[j : j + int(self.q[k])] for j in range(len(text) - int(self.q[k]) + 1)))
                if not self.packed:
                    self.sets[k] = np.minimum(there, 255)
        keys, item, offset = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.bits = min(26, max(16, int(lengths.sum() * 16).bit_length()))
        self.there = np.zeros(1 << self.bits, np.uint8)
        for exact, span in sorted(of):
            self.spans[exact].append(span)
        for (exact, span), members in sorted(of.items()):
            for k in members:
                text = self.texts[k][1]
                # pieces lie side by side, walks start at each character and stop before the item's end
                starts, pairs = np.arange(0, len(text), span if exact else 1), _pairs(_buffer([text, pad]))
                starts = starts[walks.last(pairs, starts, exact, _steps(0, span, exact)) < len(text)]
                at, h, done = starts, _start(len(starts), exact), 0
                for n in self.spans[exact][: self.spans[exact].index(span) + 1]:
                    at, h = walks.go(pairs, at, h, exact, _steps(done, n, exact))
                    self.there[_cell(h, n, self.bits)] |= _ENDS if n == span else _GOES_ON
                    done = n
                keys.append(_key(h, span))
                item.append(np.full(len(starts), k))
                offset.append(starts)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        self.item, self.offset = np.concatenate(item)[order], np.concatenate(offset)[order]
        self.keys, self.first, self.often = np.unique(flat[order], return_index=True, return_counts=True)

    def candidates(self, texts: list[bytes]) -> list[dict[int, list[tuple[int, int]]]]:
        """Of each text, by item: the stretches in which it may be, ascending. All texts walk at once."""
        found: list[dict[int, list[tuple[int, int]]]] = [{} for _ in texts]
        if not len(self.keys):
            return found
        pad = bytes(self.walks.steps)
        data = _buffer([x for t in texts for x in (t, pad)])
        lengths = np.array([len(t) for t in texts], np.int64)
        bases = np.cumsum(lengths + len(pad)) - lengths - len(pad)
        size = len(data) + 1
        met = [np.empty(0, np.int64)]
        for exact, spans in self.spans.items():
            stride = 1 if exact else STRIDE
            for lo in range(0, len(data) - len(pad) if spans else 0, _CHUNK * stride):
                starts = np.arange(0, min(_CHUNK * stride, len(data) - len(pad) - lo), stride)
                pairs = _pairs(data[lo : lo + _CHUNK * stride + len(pad) + 1])
                at, h, done = starts, _start(len(starts), exact), 0
                for span in spans:
                    at, h = self.walks.go(pairs, at, h, exact, _steps(done, span, exact))
                    done = span
                    says = self.there.take(_cell(h, span, self.bits), mode="clip")
                    window = np.flatnonzero(says & _ENDS)
                    key = _key(h[window], span)
                    first = np.searchsorted(self.keys, key)
                    equal = np.flatnonzero(self.keys.take(first, mode="clip") == key)
                    window, first = starts[window[equal]] + lo, first[equal]
                    n = self.often[first]
                    j = np.repeat(self.first[first] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    window, k = np.repeat(window, n), self.item[j]
                    base, slack = bases[np.searchsorted(bases, window, "right") - 1], self.slack[k]
                    start = np.maximum(window - base - self.offset[j], 0)
                    met.append(_distinct(k * size + base + start // slack * slack))
                    # only what begins like a longer window goes on
                    on = np.flatnonzero(says & _GOES_ON)
                    starts, at, h = starts[on], at[on], h[on]
        k, at = np.divmod(_distinct(np.concatenate(met)), size)
        n = np.searchsorted(bases, at, "right") - 1
        lo = np.maximum(at - self.slack[k], bases[n])
        hi = np.minimum(at + self.length[k] + 2 * self.slack[k], bases[n] + lengths[n])
        use = self._alike(data, k, lo, hi)
        for k, n, lo, hi in zip(k[use].tolist(), n[use].tolist(), (lo - bases[n])[use].tolist(), (hi - bases[n])[use].tolist()):
            q, grams = int(self.q[k]), self.grams[k]
            text, least = texts[n], int(self.least[k])
            here = [g for j in range(lo, hi - q + 1) if (g := text[j : j + q]) in grams]
            if len(set(here)) < least and sum(min(c, grams[g]) for g, c in Counter(here).items()) < least:
                continue  # the same again, no q-gram more often than the item has it
            near = found[n].setdefault(k, [])
            if near and lo <= near[-1][1]:
                near[-1] = (near[-1][0], max(hi, near[-1][1]))
            else:
                near.append((lo, hi))
        return found

    def _alike(self, data: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which stretches of data have enough q-grams in common with their items."""
        use = self.least[k] <= 0
        for q in np.unique(self.q[k[~use]]).tolist():
            own, wide = np.flatnonzero(~use & (self.q[k] == q)), hi - lo - q + 1
            own = own[np.lexsort((wide[own], k[own] >> 6))]
            codes = np.concatenate((_grams(data, q), np.zeros(max(1, int(wide[own].max())), np.int64)))
            for rest in np.split(own, np.flatnonzero(np.diff(k[own] >> 6)) + 1):
                bits = self.bits_of[k[rest[0]] >> 6]
                often = int(wide[rest].sum()) > len(codes)  # else bits are looked up where they are needed
                there = bits.take(codes, mode="clip") if often else codes
                while len(rest):
                    # the widest first, so many at once as a bounded table holds
                    width = max(1, int(wide[rest[-1]]))
                    part, rest = rest[-max(1, (1 << 17) // width) :], rest[: -max(1, (1 << 17) // width)]
                    got = np.lib.stride_tricks.sliding_window_view(there, width)[lo[part]]
                    got = got if often else bits.take(got, mode="clip")
                    got >>= (k[part] & 63).astype(np.uint64)[:, None]
                    got &= np.uint64(1)
                    # all are counted up to the width of the widest, which is no less, then those that reach it to their own ends
                    near = np.flatnonzero(got.sum(axis=1).astype(np.int64) >= self.least[k[part]])
                    part, got = part[near], got[near]
                    got[np.arange(width) >= wide[part][:, None]] = 0
                    near = np.flatnonzero(np.count_nonzero(got, axis=1) >= self.least[k[part]])
                    if len(near):
                        use[part[near]] = self._enough(np.where(got[near], np.lib.stride_tricks.sliding_window_view(codes, width)[lo[part[near]]], -1), k[part[near]])
        return use

    def _enough(self, code: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the codes of each row, -1 for none, are enough for its item, none counted more often than the item has it."""
        code = code.astype(np.int16)
        code.sort(axis=1)
        new = np.ones(code.shape, bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        if self.packed:
            return np.count_nonzero(new & (code >= 0), axis=1) >= self.different[k]
        place = np.arange(code.shape[1], dtype=np.int32)
        again = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
        of = self.sets.ravel().take(k[:, None] * self.sets.shape[1] + np.maximum(code, 0), mode="clip")
        return np.count_nonzero((code >= 0) & (again < of), axis=1) >= self.least[k]

    def matches(self, text: bytes, candidates: dict[int, list[tuple[int, int]]], percent: int) -> dict[int, int]:
        """Edit distance to the nearest part of text, of each candidate within percent of its length."""
        return self.all_matches([text], [candidates], percent)[0]

    def all_matches(self, texts: list[bytes], candidates: list[dict[int, list[tuple[int, int]]]], percent: int) -> list[dict[int, int]]:
        """The matches of each text with its candidates."""
        out: list[dict[int, int]] = [{} for _ in texts]
        parts = [(n, k, lo, hi) for n, near in enumerate(candidates) for k, stretches in near.items() for lo, hi in stretches]
        for (n, k, _, _), d in zip(parts, edit_distances([(self.texts[k][1], texts[n][lo:hi]) for n, k, lo, hi in parts])):
            i, item = self.texts[k]
            if 100 * d <= percent * len(item):
                out[n][i] = min(d, out[n].get(i, d))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items, in parts of a checked size."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).where("i is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = -(-size // block_bytes) or 1
    for part in range(parts):
        rows = (items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part) if parts > 1 else items).distinct().orderBy("i", "t").collect()
        yield [(r.i, bytes(r.t)) for r in rows]


def scan_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = EDIT_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """_row (a struct of docs' columns), item_id, distance, n_items for each row of docs.

    n_items items are found in the text, item_id the nearest (by edits, then id), distance its edits; null
    and 0 where none is; an item is in a text that has a part, any run of its characters, within percent edits. Texts are compared by their words, A-Z lower-cased, one space between. A null or
    empty text has none, an empty item is nowhere, an empty benchmark finds nothing. Columns of docs
    pass through whatever their names; nothing is shuffled. A benchmark above block_bytes takes a pass
    over the documents for each block of it.
    """
    walks = Walks()
    at = docs.columns.index(text_col)
    kept = StructType().add("_row", docs.schema).add("item_id", "long").add("distance", "long").add("n_items", "long")
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    state = state.select("*", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("distance"), F.lit(0).cast("long").alias("n_items"))
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(block, walks, percent)
            for b in batches:
                out, lo, whole = [], 0, b.column(0).field(at).cast(pa.binary())
                while lo < b.num_rows:
                    texts, held = [], 0
                    while lo < b.num_rows and (not texts or held < PART_BYTES):
                        texts.append(normalise(whole[lo].as_py()))
                        held += len(texts[-1])
                        lo += 1
                    for got in items.all_matches(texts, items.candidates(texts), percent):
                        j = len(out)
                        was = (b.column(2)[j].as_py(), b.column(1)[j].as_py())
                        best = min([(d, i) for i, d in got.items()] + ([was] if was[0] is not None else []), default=(None, None))
                        out.append((best[1], best[0], b.column(3)[j].as_py() + len(got)))
                new = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([b.column(0), *new], ["_row", "item_id", "distance", "n_items"])

        state = state.transform(in_arrow, scan, kept)
    return state


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, item_id, distance, n_items for each row of docs; see scan_documents."""
    found = scan_documents(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text", **options)
    return found.select("_row.doc_id", (F.col("n_items") > 0).alias("contaminated"), "item_id", "distance", "n_items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, unchanged, in which no item is found."""
    return scan_documents(docs, benchmark, text_col, **options).where("n_items = 0").select("_row.*")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
