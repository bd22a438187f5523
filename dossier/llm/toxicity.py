"""Toxicity of texts behind leetspeak, spacing and repetition: a noisy channel, then a learned score.

A character language model of the whole corpus and a channel of disguises make a lattice of each
suspicious token; Viterbi finds the likeliest plain words. The restored text is scored by words and
word beginnings whose labels differ.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.llm.common import in_arrow, materialize

#: Score from which a text counts as toxic.
THRESHOLD = 0.3
#: Labelled texts that the score is learned from, at most; those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
#: Features that the score may use, by evidence; the least evidence (likelihood ratio statistic) of one.
MOST_FEATURES, EVIDENCE = 20_000, 15.0
#: Lengths of the word beginnings among the features.
BEGINNINGS = (4, 5, 6)
#: What a character may stand for, and the cost of each disguise in nats.
DISGUISES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "(": "c"}
LEET_COST, DROP_COST, REPEAT_COST, BREAK_COST, UNKNOWN_COST = 1.0, 0.7, 0.7, 4.0, 9.0
#: Symbols of the language model: 0 between words, 1-26 letters, 27 any other letter, 28 anything else; order 4.
_BITS, _ORDER = 5, 4
#: N-grams that are counted at once.
_CODES = 1 << 19
_SEPARATORS = ".-_*~'` "
_SINGLE_RUN = 3


def fold(text: str) -> str:
    """Lower case, letters without marks."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbols of single bytes, and of the second bytes of two-byte letters after C3."""
    one, two = np.full(256, 28, np.uint8), np.full(256, 27, np.uint8)
    for c in range(128):
        s = chr(c)
        one[c] = 0 if s.isspace() else ord(s.lower()) - 96 if s.isalpha() else 28
    one[0xC0:] = 27
    one[0x80:0xC0] = 255  # dropped
    for c in range(0x80, 0xC0):
        base = fold(chr(c + 0x40))[:1]
        two[c] = ord(base) - 96 if base.isascii() and base.isalpha() else 27
    return one, two


_ONE, _TWO = _tables()


def symbols(data: np.ndarray) -> np.ndarray:
    """Language model symbols of UTF-8 bytes."""
    out = _ONE[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    out[lead + 1] = _TWO[data[lead + 1]]
    out[lead] = 255
    return out[out != 255]


def _ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of this partition's texts, one row for each that occurs."""
    counts = np.zeros(1 << (_BITS * _ORDER), np.int64)
    for b in batches:
        part, held = [], 0
        for j in range(b.num_rows + 1):
            if j < b.num_rows:
                t = b.column(0)[j].as_py()
                if t:
                    part += [b"\n", t]
                    held += len(t)
            if part and (held > 4_000_000 or j == b.num_rows):
                said = symbols(np.frombuffer(b"".join([*part, b"\n"]), np.uint8))
                for lo in range(0, len(said) - _ORDER + 1, _CODES):
                    s = said[lo : lo + _CODES + _ORDER - 1].astype(np.int64)
                    code = s[: 1 - _ORDER].copy()
                    for k in range(1, _ORDER):
                        code <<= _BITS
                        code |= s[k : len(s) - _ORDER + 1 + k]
                    counts += np.bincount(code, minlength=len(counts))
                part, held = [], 0
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["code", "n"])


def language_model(texts: DataFrame) -> np.ndarray:
    """log p(last symbol | three before it), interpolated over the orders, from the counts of all texts. 32 ** 4 numbers at most reach the driver."""
    rows = texts.transform(in_arrow, _ngrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << _BITS,) * _ORDER)
    counts.reshape(-1)[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    p = np.full(1 << _BITS, 1 / 29)
    for order in range(1, _ORDER + 1):
        c = counts.sum(axis=tuple(range(_ORDER - order)))
        seen = (c > 0).sum(axis=-1, keepdims=True)
        total = c.sum(axis=-1, keepdims=True)
        p = (c + np.maximum(seen, 1) * p) / (total + np.maximum(seen, 1))  # Witten-Bell
    return np.log(p).astype(np.float32)


class Restorer:
    """Viterbi search over the lattice of a disguised token."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def _options(self, c: str, run: int, spaced: bool) -> list[tuple[str, float]]:
        """What a run of one character may have been."""
        if c in _SEPARATORS:
            return [("", DROP_COST if spaced else DROP_COST * run), (" ", BREAK_COST)]
        if c.isascii() and c.isalpha():
            return [(c * run, 0.0 if run < 3 else REPEAT_COST * run)] * (run < 3) + [(c, REPEAT_COST)] * (run > 1) + [(c * 2, REPEAT_COST)] * (run > 2)
        stand = DISGUISES.get(c, "")
        out = [(x * min(run, 2), LEET_COST * run) for x in stand] + [(x, LEET_COST + REPEAT_COST) for x in stand if run > 1]
        return out + [("\x01", UNKNOWN_COST)]

    def restore(self, token: str) -> str:
        """The likeliest plain words of a folded token, one space between: the best path through the whole lattice."""
        return self.best(token)[1].replace("\x01", "")

    def best(self, token: str) -> tuple[float, str]:
        """(score, text) of the best path. A state is the last three symbols; a path is linked to the one that it prolongs."""
        spaced = " " in token
        paths: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
        for m in re.finditer(r"(.)\1*", token, re.S):
            grown: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
            for said, cost in self._options(m[1], len(m[0]), spaced):
                symbols = [0 if ch == " " else 28 if ch == "\x01" else ord(ch) - 96 for ch in said]
                for state, (score, path) in paths.items():
                    s = score - cost
                    a, b, c = state
                    for x in symbols:
                        s += self.model[a][b][c][x] + 1.0  # a symbol less must not win by its length alone
                        a, b, c = b, c, x
                    state = (a, b, c)
                    if state not in grown or s > grown[state][0]:
                        grown[state] = (s, (path, said))
            paths = grown
        score, path = max(((s + self.model[a][b][c][0], p) for (a, b, c), (s, p) in paths.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, said = path
            out.append(said)
        return score, "".join(reversed(out))


#: What may be cut off the ends of a token: for the word as written, and before decoding, where disguises stay.
_ENDS = re.compile(r"^[^\w@$]+|[^\w@$]+$|^_+|_+$")
_STAND = re.escape("".join(DISGUISES))
_EDGES = re.compile(rf"^[^\w{_STAND}]+|[^\w{_STAND}]+$|^_+|_+$")
_DOUBLED = re.compile(r"(.)\1+")
#: What ends a token and never stands for a letter.
_TAIL = ".,;:?"


class Reader:
    """Restored words of texts; remembers tokens up to a bound."""

    def __init__(self, model: np.ndarray, most: int = 300_000):
        self.restorer, self.known, self.most = Restorer(model), {}, most

    def words_of(self, token: str) -> tuple[str, ...]:
        """Plain words of a token in each of its readings: as written, with its repeats made single, and what the channel
        makes of it with and without the disguises at its ends. A word of letters without repeats has the first only."""
        plain = fold(token.rstrip(_TAIL))
        core = plain if plain.isalpha() else _ENDS.sub("", plain).rstrip("@$")
        out: list[str] = []
        if core.isalpha():
            out.append(core)
            if _DOUBLED.search(core):
                out.append(_DOUBLED.sub(r"\1", core))
                out += self._decoded(core)
        elif re.search(r"[a-z]", core):
            out += self._decoded(core)
        else:  # a word in another script, with its vowel signs
            word = plain.strip("".join({c for c in plain if unicodedata.category(c)[0] in "PSZ"}))
            out += [word] * any(map(str.isalpha, word))
        wide = plain if plain.isalpha() else _EDGES.sub("", plain)
        if wide != core and re.search(rf"[a-z]|[{_STAND}]", re.sub(r"\d", "", wide)):
            out += self._decoded(wide)
        return tuple(dict.fromkeys(out))

    def _decoded(self, core: str) -> list[str]:
        return self.restorer.restore(core).split() if len(core) >= 3 and re.search(rf"[a-z{_STAND}]", core) else []

    def read(self, text: str) -> list[tuple[str, ...]]:
        tokens = text.split()
        known = self.known
        if len(known) > self.most:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = self.words_of(t)
        out = [known[t] for t in tokens]
        return out + self.spelled(tokens)

    @staticmethod
    def single(token: str) -> str:
        """The character that a token consists of, punctuation around it aside, or none."""
        if len(token) > 1:
            token = _EDGES.sub("", token) if len(token) <= 4 and not token.isalpha() else ""
        return token if len(token) == 1 else ""

    def spelled(self, tokens: list[str]) -> list[tuple[str, ...]]:
        """Restored words of runs of single characters."""
        out: list[tuple[str, ...]] = []
        ones = {t: self.single(t) for t in set(tokens) if len(t) <= 4}
        chars = [ones.get(t, "") for t in tokens]
        single = np.fromiter(map(len, chars), np.int64, len(chars)) == 1
        if single.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([False], single, [False])).astype(np.int8)))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= _SINGLE_RUN and len(set(chars[a:b])) > 1:
                    out.append(tuple(self.restorer.restore(fold(" ".join(chars[a:b]))).split()))
        return out


def features(words: tuple[str, ...]) -> set[str]:
    return {w for w in words} | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) >= n}


class Scorer:
    """Strongest and three strongest different features of a text, through a logistic curve."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float, float]):
        self.weights, self.curve, self.known = weights, curve, {}

    def strength(self, words: tuple[str, ...]) -> tuple[float, str]:
        got = self.known.get(words)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[words] = max(((self.weights.get(f, 0.0), f) for f in features(words)), default=(0.0, ""))
        return got

    def signals(self, read: list[tuple[str, ...]]) -> tuple[float, float]:
        best: dict[str, float] = {}
        for words in set(read):
            w, f = self.strength(words)
            if w > 0:
                best[f] = w
        top = sorted(best.values(), reverse=True)[:3]
        return (top[0] if top else 0.0), sum(top)

    def score(self, signals: tuple[float, float]) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * signals[0] + c * signals[1], -30, 30))))


class TokenScorer:
    """What Scorer.signals(Reader.read(text)) says, token by token: each distinct token is judged once, and texts meet by set
    intersection the few tokens that carry weight."""

    def __init__(self, scorer: Scorer, model: np.ndarray, most: int = 300_000):
        self.scorer, self.reader, self.most = scorer, Reader(model, most), most
        self.weights = {f: w for f, w in scorer.weights.items() if w > 0}
        self._forget()

    def _forget(self) -> None:
        self.known: set[str] = set()
        self.heavy: set[str] = set()
        self.single: set[str] = set()
        self.said: dict[str, tuple[float, str]] = {}
        self.of_word: dict[str, tuple[float, str] | None] = {}

    def _strongest(self, words: tuple[str, ...]) -> tuple[float, str] | None:
        weights, best = self.weights, None
        for w in words:
            if w in weights and (best is None or (weights[w], w) > best):
                best = (weights[w], w)
            for n in BEGINNINGS:
                if len(w) < n:
                    break
                if (f := w[:n] + "*") in weights and (best is None or (weights[f], f) > best):
                    best = (weights[f], f)
        return best

    def _of_word(self, word: str) -> tuple[float, str] | None:
        """_strongest(words_of(word)). Of letters, the channel can only make repeats single or double: where no such spelling has a weight, none is sought."""
        plain = fold(word)
        if plain.isascii() and plain.isalpha():
            if not (repeats := _DOUBLED.findall(plain)):
                return self._strongest((plain,))
            if len(repeats) <= 6:
                pieces, ends = _DOUBLED.split(plain)[::2], [(c, c * 2) for c in repeats]
                spellings = ["".join(itertools.chain.from_iterable(zip(pieces, [*said, ""]))) for said in itertools.product(*ends)]
                if self._strongest((plain, *spellings)) is None:
                    return None
        return self._strongest(self.reader.words_of(word))

    def signals(self, text: str) -> tuple[float, float]:
        tokens = text.split()
        met = set(tokens)
        if len(self.known) > self.most:
            self._forget()
        new = met - self.known
        of_word = self.of_word
        for t in new:
            if len(t) <= 4 and self.reader.single(t):
                self.single.add(t)
            word = t.rstrip(_TAIL).lower()  # reads as t does
            if word in of_word:
                found = of_word[word]
            else:
                found = of_word[word] = self._of_word(word)
            if found is not None:
                self.said[t] = found
                self.heavy.add(t)
        self.known |= new
        best = {f: w for w, f in (self.said[t] for t in met & self.heavy)}
        # only a run with two different single characters is decoded as a whole
        if len(met & self.single) > 1:
            for words in self.reader.spelled(tokens):
                if (found := self._strongest(words)) is not None:
                    best[found[1]] = found[0]
        top = sorted(best.values(), reverse=True)[:3]
        return (top[0] if top else 0.0), sum(top)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of y on x (n, 2), by Newton's method with a small penalty."""
    one = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        g = one.T @ (y - p) - 0.1 * np.array([0, w[1], w[2]])
        h = (one * (p * (1 - p))[:, None]).T @ one + np.diag([1e-6, 0.1, 0.1])
        w = w + np.linalg.solve(h, g)
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Learns from docs (_id, _text) with labels (_id, toxic), of rows whose crc32(id) mod 4 is not 2, at most train_rows of them."""
    known = labels.where("_id is not null and toxic is not null").where(F.crc32(F.col("_id").cast("string").cast("binary")) % 4 != 2)
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)  # the documented bound
    sample = docs.join(F.broadcast(known), "_id").select("toxic", F.col("_text").alias("_text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in batches:
            toxic, lists = b.column(0).to_pylist(), []
            for t in b.column(1).to_pylist():
                lists.append(["\x1f".join(w) for w in dict.fromkeys(reader.read((t or b"").decode("utf-8", "replace")))])
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(lists, pa.list_(pa.string()))], ["toxic", "read"])

    texts = materialize(sample.select(F.col("toxic").cast("int"), "_text").transform(in_arrow, read, "toxic int, read array<string>"), "tox-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for b in batches:
            for toxic, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got: set[str] = set()
                for x in lists:
                    got |= features(tuple(filter(None, x.split("\x1f"))))
                (pos if toxic else neg).update(got)
        names = list(pos | neg)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[f] for f in names], pa.int64()), pa.array([neg[f] for f in names], pa.int64())], ["feature", "pos", "neg"])

    n = texts.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    rows, toxic = n[0], n[1]
    if not rows or not toxic or toxic == rows:
        return Scorer({}, (30.0 if rows and toxic == rows else -30.0, 0.0, 0.0))
    base = toxic / rows
    both = F.col("pos") + F.col("neg")
    g2 = 2 * (F.col("pos") * F.log(F.greatest(F.col("pos"), F.lit(1e-9)) / (both * base)) + F.col("neg") * F.log(F.greatest(F.col("neg"), F.lit(1e-9)) / (both * (1 - base))))
    counted = texts.transform(in_arrow, count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = counted.where(F.col("pos") > both * base).withColumn("g2", g2).where(F.col("g2") > EVIDENCE).orderBy(F.col("g2").desc(), "feature").limit(MOST_FEATURES).collect()
    prior = 2.0
    weights = {r.feature: float(np.log((r.pos + prior * base) / (r.neg + prior * (1 - base))) - np.log(base / (1 - base))) for r in best}
    scorer = Scorer(weights, (0.0, 0.0, 0.0))

    def signal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scorer.signals([tuple(filter(None, x.split("\x1f"))) for x in lists]) for lists in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["toxic", "a", "b"])

    seen = texts.transform(in_arrow, signal, "toxic int, a double, b double").toPandas()  # train_rows rows of three numbers
    scorer.curve = _curve(seen[["a", "b"]].to_numpy(), (seen["toxic"] > 0).to_numpy(float))
    scorer.known = {}
    return scorer


def score_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, carry: list[str] | None = None) -> DataFrame:
    """_row (a struct of docs' columns, or of those in carry), score for each row of docs.

    The language model is counted over all texts, the score learned from the labelled sample, both
    in this call. A null text scores as an empty one: no signal, the curve's least. Without labels, or
    with one label only, all scores are the same. Columns of docs pass through whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    model = language_model(texts.select("_text"))
    scorer = train(texts, labels.select(F.col("doc_id").alias("_id"), "toxic"), model, train_rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TokenScorer(scorer, model)
        for b in batches:
            out = []
            texts = b.column(1) if at is None else b.column(0).field(at).cast(pa.binary())
            for j in range(b.num_rows):
                text = (texts[j].as_py() or b"").decode("utf-8", "replace")
                out.append(scorer.score(reader.signals(text)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["_row", "score"])

    kept = docs if carry is None else docs.select(*carry)
    at = kept.columns.index(text_col) if text_col in kept.columns else None  # a text that is carried is not sent twice
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), *([F.col(text_col).cast("binary").alias("_text")] if at is None else []))
    return rows.transform(in_arrow, scan, StructType().add("_row", kept.schema).add("score", "double"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; see score_rows. A null id is not held out."""
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = score_rows(thin, labels, "doc_id", "text", train_rows, ["doc_id"]).select("_row.doc_id", "score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, unchanged, that score below threshold."""
    return score_rows(docs, labels, id_col, text_col).where(F.col("score") < threshold).select("_row.*")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
