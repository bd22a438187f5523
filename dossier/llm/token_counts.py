"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import in_arrow

#: Vocabulary file of the public_tokenizers package.
VOCABULARY = "word_bpe_49k.json"
#: Bytes that go to the encoder in one batch.
BATCH_BYTES = 1 << 20
#: Words whose counts a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 400_000, 64
TOKEN_LIMIT = 2048


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Texts that tell whether white space between words counts for nothing.
_WORDS = ("a", "B2", "don't", "...", "é", "x_y", "日本", "-")


class Counter:
    """Token counts of texts under a vocabulary file: .model of sentencepiece, others of the tokenizers library.

    Where the vocabulary drops white space between words, white space is a safe boundary: no token, no special string
    and no normalisation reaches across it. A text is split there, words that were met before are looked up, and new ones go to the
    encoder in batches of about as many bytes. A run without white space stays whole however long it is. Under any other vocabulary texts
    are encoded whole.
    """

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES):
        self.batch_bytes, self.known = batch_bytes, {}
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths, special = lambda batch: list(map(len, pieces.encode(batch))), {}
        else:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.no_truncation()
            made.no_padding()
            self.lengths, special = lambda batch: [len(e) for e in made.encode_batch_fast(batch, add_special_tokens=False)], made.get_added_tokens_decoder()
        alone = any(t.lstrip or t.rstrip or t.single_word or len(t.content.split()) != 1 for t in special.values())
        self.whole = alone or self.lengths([f" \n{x}\t \x0b\x0c{y}  " for x in _WORDS for y in _WORDS]) != [a + b for a in self.lengths(list(_WORDS)) for b in self.lengths(list(_WORDS))]

    def encode(self, words: list[bytes]) -> list[int]:
        out: list[int] = []
        batch: list[str] = []
        held = 0
        for w in [*words, None]:
            if batch and (w is None or held + len(w) > self.batch_bytes):
                out += self.lengths(batch)
                batch, held = [], 0
            if w is not None:
                batch.append(w.decode())
                held += len(w)
        return out

    def count(self, texts: list[bytes]) -> list[int]:
        if self.whole:
            return self.encode(texts)
        split = [t.split() for t in texts]  # bytes split at \x20 and \x09-\x0D
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({w for words in split for w in words if w not in known})
        known.update(zip(new, self.encode(new), strict=True))
        out = [sum(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out


@functools.lru_cache(maxsize=1)
def counter_of(path: str) -> Counter:
    """The counter of a worker, which keeps its words for later tasks. A task has one core, on which the encoder's threads would only wait for each other."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    A null text counts as empty: 0 bytes and tokens. Texts of any length are counted whole. Other columns are ignored, repeated rows each get
    their row, and an empty table gives an empty result. path: any vocabulary file of the two libraries that Counter knows.
    """
    path = path or vocabulary_path()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for b in batches:
            texts = b.column(1).fill_null(b"")
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :]) if pa.types.is_binary(texts.type) else np.array([len(x.as_py()) for x in texts])
            counts: list[int] = []
            start = 0
            ends = np.cumsum(sizes, dtype=np.int64)
            while start < len(texts):  # parts of about as many bytes, at least a text each
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + 4 * BATCH_BYTES, "right")))
                counts += counter.count(texts.slice(start, stop - start).to_pylist())
                start = stop
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    thin = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = thin.schema["_id"].dataType.simpleString()
    found = thin.transform(in_arrow, scan, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return found.select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
