"""Held-out quality, exactness of the searches, and rows without, or with one and the same, id."""

import itertools
import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_operators import SCHEMA, table

from dossier.llm import decontaminate, language_id, mixing, ngram_join, token_counts, toxicity


def test_viterbi_finds_the_best_path_of_all():
    r = random.Random(4)
    for seed in range(3):
        restorer = toxicity.Restorer(np.random.default_rng(seed).normal(-3, 2, (32,) * 4).astype(np.float32))
        for _ in range(60):
            token = "".join(r.choice("ab1|@$.s ee") for _ in range(r.randint(1, 7)))
            options = [restorer._options(m[1], len(m[0]), " " in token) for m in re.finditer(r"(.)\1*", token, re.S)]
            best = -1e9
            for said in itertools.product(*options):
                state, score = (0, 0, 0), -sum(c for _, c in said)
                for ch in "".join(x for x, _ in said):
                    x = 0 if ch == " " else 28 if ch == "\x01" else ord(ch) - 96
                    score += restorer.model[state[0]][state[1]][state[2]][x] + 1.0
                    state = (*state[1:], x)
                best = max(best, score + restorer.model[state[0]][state[1]][state[2]][0])
            assert restorer.best(token)[0] == pytest.approx(best)


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(11)
    clean = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(3, 8))) for _ in range(300)]
    bad, leet = ["idiot", "moron", "scumbag", "loser"], str.maketrans("iosa", "105@")
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(clean) for _ in range(25)]
        if i % 3 == 0:
            x = r.choice(bad)
            w.insert(r.randrange(25), r.choice([x, x.translate(leet), ".".join(x), x.replace("o", "ooo"), " ".join(x), x.upper()]))
        rows.append((i, " ".join(w), "en", "s", 0, 0, "", ""))
        labels.append((i, 1, int(i % 3 == 0)))
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [x for x in toxicity.score_toxicity(df, lab).collect() if x.held_out]
    assert len(got) > 150 and all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in got)
    caught = [x.predicted for x in got if x.doc_id % 3 == 0]
    assert sum(caught) >= 0.95 * len(caught) and sum(x.predicted for x in got if x.doc_id % 3) <= 0.02 * len(got)
    assert toxicity.score_toxicity(df.limit(0), lab).count() == 0
    odd = spark.createDataFrame([(None, "idiot"), (None, "idiot"), (3, "x" * 200_000), (3, "1dl0t@" * 2_000), (4, "")], "doc_id long, text string")
    assert toxicity.score_toxicity(df.select("doc_id", "text").unionByName(odd), lab).count() == 905


@pytest.mark.parametrize("words_of_item", [12, 35, 120])
def test_decontamination_recall_by_edits(words_of_item):
    r = random.Random(words_of_item)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(words_of_item).encode()) for k in range(40)]
    found = decontaminate.Items(items, decontaminate.Walks())
    for percent in (5, 10, 15, 19):
        docs = []
        for _, raw in items:
            x = list(raw.decode())
            for p in sorted(r.sample(range(len(x)), len(x) * percent // 100), reverse=True):
                x[p : p + 1] = r.choice(["", "z", x[p] + "y", "x"])
            docs.append(" ".join(f"{text(40)} {''.join(x)} {text(40)}".split()).encode())
        near = [found.matches(d, c, 20) for d, c in zip(docs, found.candidates(docs))]
        # against brute force: the distance of every item to every document
        for d, got in zip(docs, near):
            within = {k for k, item in items if 5 * decontaminate.edit_distance(item, d) <= len(item)}
            assert got.keys() <= within
        hit = [k for k, d in enumerate(docs) if 5 * decontaminate.edit_distance(items[k][1], d) <= len(items[k][1])]
        assert len(hit) >= 36 and sum(k in near[k] for k in hit) >= 0.9 * len(hit), percent


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_any_vocabulary(name):
    path = token_counts.vocabulary_path(name)
    texts = ["", "  two  spaces\n\n and <|endoftext|>tabs\t", "don't 12,5　x é日本 " * 40, "y" * 3000, " <s> a"]
    if name.endswith(".model"):
        import sentencepiece

        want = list(map(len, sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)))
    else:
        from tokenizers import Tokenizer

        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    counter = token_counts.Counter(path)
    assert counter.count([t.encode() for t in texts]) == want and counter.whole == (name != "word_bpe_49k.json")


def test_tokens_are_counted_on_one_thread_by_one_counter():
    code = """
import os
from dossier.llm import token_counts
before = len(os.listdir('/proc/self/task'))
counter = token_counts.counter_of(token_counts.vocabulary_path())
assert counter.count([b' '.join(b'w%d' % k for k in range(5000))]) == [sum(1 + len(str(k)) for k in range(5000))]
assert len(os.listdir('/proc/self/task')) == before
assert token_counts.counter_of(token_counts.vocabulary_path()) is counter and len(counter.known) == 5000
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=120)


def test_rows_without_or_with_one_id(spark):
    """Null ids, repeated ids and repeated rows: each row has its answer, equal rows the same one."""
    w = " ".join(f"w{k}" for k in range(80))
    rows = [(None, w), (None, w), (1, w), (1, w + " more"), (2, w), (2, w), (3, None), (None, None)]
    df = table(spark, rows)
    tokens = token_counts.count_tokens(df).collect()
    assert len(tokens) == len(rows) and len({(x.n_bytes, x.n_tokens) for x in tokens}) == 3
    assert token_counts.count_tokens(df.limit(0)).count() == 0
    joined = ngram_join.link_components(df).collect()
    assert len(joined) == len(rows) and {x.component_id for x in joined if x.doc_id in (1, 2)} == {1} and {x.component_id for x in joined if x.doc_id is None} == {None}
    mixed = mixing.mix_sources(df).collect()
    assert len(mixed) == len(rows) and sum(x.taken for x in mixed) > 0
    item = spark.createDataFrame([(1, w), (1, w), (None, "x"), (2, None)], "item_id long, text string")
    found = decontaminate.decontaminate(df, item).collect()
    assert sorted(x.contaminated for x in found) == [False] * 2 + [True] * 6
    assert decontaminate.decontaminate(df.limit(0), item).count() == 0 and not any(x.contaminated for x in decontaminate.decontaminate(df, item.limit(0)).collect())
    said = language_id.identify_languages(df, steps=5).collect()
    assert len(said) == len(rows) and sum(x.lang_pred == "und" for x in said) == 2


@pytest.mark.parametrize("packed", [False, True])
def test_stretches_are_counted_as_one_by_one(packed):
    """Bit masks of items say the same as the q-grams of each stretch and its item."""
    r = random.Random(5)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(2, 5))) for _ in range(40)]
    texts = [" ".join(r.choice(words) for _ in range(n)).encode() for n in [r.randint(1, 40) for _ in range(150)]]
    items = decontaminate.Items(list(enumerate(texts)), decontaminate.Walks())
    items.packed = packed
    data = decontaminate._buffer([" ".join(r.choice(words) for _ in range(3000)).encode(), bytes(24)])
    k = np.array([r.randrange(150) for _ in range(1500)])
    lo = np.array([r.randrange(len(data) - 24) for _ in k])
    hi = np.minimum(lo + items.length[k] + r.randint(1, 40), len(data) - 24)
    want = []
    for j in range(len(k)):
        q, least = int(items.q[k[j]]), int(items.least[k[j]])
        has = np.bincount(decontaminate._grams(decontaminate._buffer([texts[k[j]]]), q), minlength=1 << 15)
        got = np.bincount(decontaminate._grams(data[lo[j] : hi[j]], q), minlength=1 << 15)
        enough = np.count_nonzero((got > 0) & (has > 0)) >= items.different[k[j]] and got[has > 0].sum() >= least if packed else np.minimum(got, has).sum() >= least
        want.append(bool(least <= 0 or enough))
    assert 0 < sum(want) < len(want)
    assert items._alike(data, k, lo, hi).tolist() == want
    assert items.bits_of.shape == (3, 1 << 15)  # one look-up for 64 items


def test_walks_of_two_steps_read_the_same_and_only_beginnings_of_items_go_on(monkeypatch):
    r = random.Random(8)
    walks, data = decontaminate.Walks(), decontaminate._buffer([bytes(r.randrange(1, 256) for _ in range(500)), bytes(24)])
    at, code = [], []
    for start in range(500):  # step by step
        p, c = start, 1
        for step in range(24):
            c = (c * 0x100000001B3 + int(data[p])) % (1 << 64)
            p += int(walks.bits[step][data[p]])
        at.append(p)
        code.append(c)
    got = walks.go(decontaminate._pairs(data), np.arange(500), np.ones(500, np.uint64), False, range(24))
    assert got[0].tolist() == at and got[1].tolist() == code
    text = lambda letters, n: "".join(r.choice(letters) for _ in range(n)).encode()
    items = decontaminate.Items([(n, text("abcdef", n)) for n in (60, 90, 150, 240, 330)], walks)
    walked, go = [], decontaminate.Walks.go
    monkeypatch.setattr(decontaminate.Walks, "go", lambda self, pairs, at, *rest: walked.append(len(at)) or go(self, pairs, at, *rest))
    docs = [text("uvwxyz", 20_000), text("uvwxyz", 500) + items.texts[4][1] + text("uvwxyz", 500)]
    found = items.candidates(docs)
    assert found[0] == {} and items.all_matches(docs, found, 20) == [{}, {330: 0}]
    assert len(walked) > 2 and sum(walked[1:]) < 0.1 * walked[0]


def test_edit_distances_side_by_side_are_those_of_each():
    r = random.Random(4)
    text = lambda n: bytes(r.choice(b"abc") for _ in range(n))
    pairs = [(text(r.choice([0, 1, 7, 40, 300, 2500])), text(r.choice([0, 1, 50, 400]))) for _ in range(120)]
    pairs += [(p, text(30) + p + text(9000)) for p in (text(20), text(64))]  # longer than the steps that are kept
    assert decontaminate.edit_distances(pairs) == [decontaminate.edit_distance(*x) for x in pairs]
    assert decontaminate.edit_distances([]) == []


def test_decontamination_holds_little_of_a_batch_at_once(spark, monkeypatch):
    """A batch of 4 MB, as a worker scans it: tables are made for a part of it at a time, and each planted item is found."""
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    said = lambda n: " ".join(r.choices(words, k=n))
    items, texts = [said(40) for _ in range(20)], [said(3000) for _ in range(200)]
    planted = {n: n % 20 for n in range(0, 200, 7)}
    texts = [f"{t} {items[planted[n]]} {t[:500]}" if n in planted else t for n, t in enumerate(texts)]
    assert sum(map(len, texts)) > 4_000_000
    scans = []
    monkeypatch.setattr(decontaminate, "in_arrow", lambda df, scan, schema: scans.append(scan) or df)
    decontaminate.scan_documents(spark.createDataFrame([(0, "")], "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    rows = pa.StructArray.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    none = pa.nulls(200, pa.int64())
    batch = pa.RecordBatch.from_arrays([rows, none, none, pa.array([0] * 200, pa.int64())], ["_row", "item_id", "distance", "n_items"])
    tracemalloc.start()
    try:
        got = [x for b in scans[0](iter([batch])) for x in b.column(1).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == [planted.get(n) for n in range(200)]
    assert peak < 50e6, peak


def test_ngrams_are_counted_in_little_memory():
    """8 MB of texts, as a worker counts them: all n-grams of a run of texts, and tables for a part of them at a time."""
    r = random.Random(6)
    said = "".join(r.choice("abcdefgh .,1") for _ in range(100_000))
    texts = [None, "", "a", *(said[n:] + said[:n] for n in range(0, 80_000, 1000))]
    batch = pa.RecordBatch.from_arrays([pa.array([t and t.encode() for t in texts], pa.binary())], ["_text"])
    tracemalloc.start()
    try:
        (got,) = toxicity._ngrams(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want, run = np.zeros(1 << 20, np.int64), []
    for t in [*(t for t in texts if t), None]:  # runs end with the text that brings them over 4 MB
        run += [t] * (t is not None)
        if sum(map(len, run)) > 4_000_000 or t is None:
            s = toxicity.symbols(np.frombuffer("".join(f"\n{x}" for x in run).encode() + b"\n", np.uint8)).astype(np.int64)
            want += np.bincount(s[:-3] << 15 | s[1:-2] << 10 | s[2:-1] << 5 | s[3:], minlength=1 << 20)
            run = []
    assert got.column(0).to_pylist() == np.flatnonzero(want).tolist() and got.column(1).to_pylist() == want[want > 0].tolist()
    assert peak < 60e6, peak
