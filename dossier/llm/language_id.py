"""Language ID by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import in_arrow

#: Bytes of a window; neighbours overlap, so that no filter misses a place of the text.
WINDOW, WIDTHS, FILTERS, DIMENSIONS = 256, (2, 3, 4), 8, 8
STRIDE = WINDOW - max(WIDTHS) + 1
#: Labelled texts that the network is trained on, at most: of a language, and of all together. Every language has one at least.
TRAIN_ROWS, TRAIN_TOTAL = 600, 20_000
#: Windows of one such text, at most; longer texts give as many, spread over the whole of them.
TRAIN_WINDOWS = 512
STEPS, BATCH, RATE = 500, 64, 0.01
#: Windows that go through the network at once.
AT_ONCE = 512
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that may be part of a letter.
_LETTER_BYTES = np.array([chr(c).isalpha() or c >= 0x80 for c in range(256)])


def windows(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes of the whole text, zeros after its end."""
    n = max(1, -(-(len(text) - (WINDOW - STRIDE)) // STRIDE))
    data = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, WINDOW)[::STRIDE]


def telling(text: bytes) -> np.ndarray:
    """The windows that may hold a letter; others say nothing of the language."""
    w = windows(text)
    return w[_LETTER_BYTES[w].any(axis=1)]


class Network:
    """Embedding, a convolution of each width, max over the window, softmax."""

    def __init__(self, classes: int, seed: int = 3):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32)
        self.embed[0] = 0
        self.conv = [r.normal(0, (w * DIMENSIONS) ** -0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.conv, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over windows x of classes y. Max pooling passes each gradient to one place."""
        n = len(x)
        e = self.embed[x]
        pooled, places = [], []
        for w, c, b in zip(WIDTHS, self.conv, self.bias):
            size = WINDOW - w + 1
            z = sum(e[:, j : j + size] @ c[j] for j in range(w)) + b
            at = z.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        z = np.concatenate(pooled, 1)
        h = np.maximum(z, 0)
        s = h @ self.out + self.out_bias
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        d_h = (p @ self.out.T) * (z > 0)
        d_embed, d_conv, d_bias = np.zeros_like(self.embed), [], []
        for k, (w, c, at) in enumerate(zip(WIDTHS, self.conv, places)):
            d = d_h[:, k * FILTERS : (k + 1) * FILTERS]
            where = at[:, None] + np.arange(w)[None, :, None]  # (n, w, filters) places read
            bytes_read = x[np.arange(n)[:, None, None], where]
            read = self.embed[bytes_read]
            d_conv.append(np.einsum("nf,nwfd->wdf", d, read))
            d_bias.append(d.sum(0))
            np.add.at(d_embed, bytes_read, d[:, None, :, None] * c.transpose(0, 2, 1)[None])
        return [d_embed, *d_conv, *d_bias, h.T @ p, p.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> None:
        """Adam on balanced batches, in an order that is the same each time."""
        r = np.random.default_rng(5)
        of = [np.flatnonzero(y == k) for k in range(len(self.out_bias))]
        m = [np.zeros_like(p) for p in self.parameters()]
        v = [np.zeros_like(p) for p in self.parameters()]
        for t in range(1, steps + 1):
            pick = np.array([r.choice(of[k]) for k in r.integers(0, len(of), BATCH)])
            for p, g, a, b in zip(self.parameters(), self.gradients(x[pick], y[pick]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            self.embed[0] = 0

    def tables(self) -> list:
        """The convolutions as sums of table rows: of pairs of bytes, and of a byte that is left."""
        pairs = []
        for c, b in zip(self.conv, self.bias):
            at = [self.embed @ c[j] for j in range(len(c))]
            rows = [(at[j][:, None] + at[j + 1][None]).reshape(65536, FILTERS) for j in range(0, len(c) - 1, 2)]
            rows[0] = rows[0] + b
            pairs.append((rows, at[-1] if len(c) % 2 else None))
        return pairs


def log_probabilities(x: np.ndarray, tables: list, out: np.ndarray, out_bias: np.ndarray) -> np.ndarray:
    """(windows, classes)."""
    pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
    pooled = []
    for w, (rows, single) in zip(WIDTHS, tables):
        size = WINDOW - w + 1
        z = rows[0].take(pair[:, :size], axis=0)
        for j, r in enumerate(rows[1:], 1):
            z += r.take(pair[:, 2 * j : 2 * j + size], axis=0)
        if single is not None:
            z += single.take(x[:, w - 1 : w - 1 + size], axis=0)
        pooled.append(z.max(axis=1))
    s = np.maximum(np.concatenate(pooled, 1), 0) @ out + out_bias
    s -= s.max(1, keepdims=True)
    return s - np.log(np.exp(s).sum(1, keepdims=True))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, steps: int = STEPS) -> tuple[list[str], Network | None]:
    """Languages and network from docs (_id, _text, _lang), of rows whose crc32(id) mod 3 is not 1: per language the train_rows texts with the smallest hashes.

    One pass counts the languages, one takes all their texts: about twice the bound leaves the scan, wherever it is, then
    each language is cut to it. Windows are cut on the executors, from whole texts.
    """
    usable = docs.where("_lang is not null and _text is not null").where(F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 3 != 1, F.lit(False)))
    counted = {r["_lang"]: r["count"] for r in usable.groupBy("_lang").count().collect()}  # a row for each language
    if not counted:
        return [], None
    per = max(1, min(train_rows, TRAIN_TOTAL // len(counted)))
    bounds = docs.sparkSession.createDataFrame([(name, int((1 << 40) * min(1.0, (2 * per + 20) / n))) for name, n in counted.items()], "_lang string, most long")
    hashed = usable.join(F.broadcast(bounds), "_lang").where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 40)) < F.col("most"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    rows = hashed.select("_lang", "_id", "_text", place.alias("place")).where(F.col("place") <= per)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = t.as_py()
                if _LETTER.search(text.decode("utf-8", "replace")):
                    w = telling(text)
                    out.append((name, k, w[np.linspace(0, len(w) - 1, min(len(w), TRAIN_WINDOWS)).astype(int)].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.binary()))], ["lang", "place", "windows"])

    found = sorted(tuple(r) for r in rows.select("_lang", "place", "_text").transform(in_arrow, cut, "lang string, place int, windows binary").collect())  # TRAIN_TOTAL rows at most
    if not found:
        return sorted(counted), None
    made = sorted({name for name, _, _ in found})
    x = [np.frombuffer(bytes(w), np.uint8).reshape(-1, WINDOW) for _, _, w in found]
    y = np.repeat([made.index(name) for name, _, _ in found], [len(w) for w in x])
    net = Network(len(made))
    net.fit(np.concatenate(x), y, steps)
    return made, net


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    Every window of the whole text that may hold a letter goes through the network; the mean of their log probabilities decides.
    Texts of any length are read whole. Null, empty and letterless texts are `und` with score 0, as is everything when no row can be
    learned from. Equally likely languages go by name; rows that repeat get the same answer. A null id is not held out and not learned from. Other columns are ignored; an
    empty table gives an empty result.
    """
    thin = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    names, net = train(thin, train_rows, steps)
    tables, out, out_bias = (net.tables(), net.out, net.out_bias) if net else ([], None, None)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            total, count = np.zeros((n, max(1, len(names)))), np.zeros(n)
            held, owner, size = [], [], 0

            def flush():
                nonlocal held, owner, size
                if held:
                    x, o = np.concatenate(held), np.concatenate(owner)
                    for lo in range(0, len(x), AT_ONCE):
                        np.add.at(total, o[lo : lo + AT_ONCE], log_probabilities(x[lo : lo + AT_ONCE], tables, out, out_bias))
                    np.add.at(count, o, 1)
                held, owner, size = [], [], 0

            for j in range(n):
                text = b.column(1)[j].as_py()
                if tables and text and _LETTER.search(text.decode("utf-8", "replace")):
                    w = telling(text)
                    held.append(w)
                    owner.append(np.full(len(w), j))
                    size += len(w)
                    if size >= 8 * AT_ONCE:
                        flush()
            flush()
            mean = total / np.maximum(count, 1)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            said = [names[k] if c else "und" for k, c in zip(best, count)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array(np.where(count > 0, p.max(1), 0.0), pa.float64())], ["_id", "lang_pred", "score"])

    kind = thin.schema["_id"].dataType.simpleString()
    found = thin.select("_id", "_text").transform(in_arrow, scan, f"_id {kind}, lang_pred string, score double")
    held_out = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select(F.col("_id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
