"""The corpus operators against brute force, on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from dossier.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, sig string, _id string"


def table(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), 7, "x", "y") for i, t in texts], SCHEMA)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(200)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 5, 40, 120, 400]))) for _ in range(n)]
    for j in range(0, n, 5):  # near copies
        w = texts[j].split()
        for _ in range(max(1, len(w) // 60)):
            if w:
                w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    texts += [f"{t} {passage} {u}" for t, u in zip(texts[:8], texts[8:16])]
    texts += [texts[3], texts[7].upper(), "", None, "   ", "w " * 300]
    return list(enumerate(texts))


def words(t):
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(spark):
    rows = corpus()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    for capacity in (1, 20_000):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(table(spark, rows), capacity=capacity).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            g, r = groups[lower(t)], got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256(lower(t).encode()).hexdigest())
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_extendible_directory_splits_until_buckets_fit(spark):
    r = random.Random(1)
    hashes = [r.getrandbits(64) - (1 << 63) for _ in range(500)] + [(7 << 50) + k for k in range(40)] + [-1, 0]
    slots = spark.createDataFrame([(h,) for h in hashes], "h long")
    cells, depth = exact_dedup.directory(slots, 10)
    got = cells.collect()
    cell = lambda h, bits: (h % (1 << 64)) >> (64 - bits) if bits else 0
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    assert {c.cell for c in got} == {signed(cell(h, depth)) for h in hashes} and depth >= 56  # neighbours differ in their last bits only
    for c in got:
        members = [h for h in hashes if signed(cell(h, c.bucket_depth)) == c.bucket]
        assert c.held == len(members) <= 10
        if c.bucket_depth:  # the bucket was split because the one above held too much
            assert len([h for h in hashes if cell(h, c.bucket_depth - 1) == cell(members[0], c.bucket_depth - 1)]) > 10
    rows = corpus()
    found = exact_dedup.exact_dedup(table(spark, rows), capacity=3).collect()
    assert len({x.bucket for x in found}) > 5 and {x.chain for x in found} == {1}


def test_exact_dedup_of_repeated_and_missing_ids(spark):
    rows = [(1, "A"), (1, "b"), (2, "a"), (None, "c"), (None, "C"), (3, None), (4, ""), (4, "")]
    got = sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.kept) for x in exact_dedup.exact_dedup(table(spark, rows)).collect())
    assert got == [("1", "1", 1, True), ("1", "2", 2, False), ("2", "2", 2, True), ("3", "4", 3, False), ("4", "4", 3, True), ("4", "4", 3, True), ("None", "None", 2, True), ("None", "None", 2, True)]


def test_ngram_join(spark):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = set(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(table(spark, rows)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(got)
    assert ngram_join.link_components(table(spark, [])).count() == 0


def test_join_signatures_never_miss():
    """Any two linked sets share an indexed signature, whatever cells are heavy."""
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(400):
        size = int(r.integers(1, 200))
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        gone = int(r.integers(0, len(a) // 4 + 1))
        b = np.unique(np.concatenate([r.permutation(a)[: len(a) - gone], r.integers(0, 2**63, int(r.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        heavy = r.random(ngram_join.CELLS) < 0.5
        x, y = (set(np.concatenate(ngram_join.signatures(s, 80, heavy)).tolist()) for s in (a, b))
        assert x & y


def brute_rows(rows, window):
    """Masks row by row: rows under one id take nothing from each other, rows without id neither give nor lose."""
    first = {}
    for i, t in rows:
        for j in range(len(t) - window + 1 if i is not None else 0):
            x = tuple(t[j : j + window])
            first[x] = min(first.get(x, i), i)
    for i, t in rows:
        mask = [False] * len(t)
        for j in range(len(t) - window + 1 if i is not None else 0):
            if first[tuple(t[j : j + window])] < i:
                mask[j : j + window] = [True] * window
        yield mask


def skewed(seed=3):
    """A common line and a common passage in many rows, repeated and missing ids, zero bytes."""
    r = random.Random(seed)
    word = lambda a: "".join(r.choice(a) for _ in range(4))
    line, passage = " ".join(word("abcdef") for _ in range(8)), " ".join(word("abcdef") for _ in range(60))
    rows = corpus() + [(1000 + j, f"{' '.join(word('abcd\0é') for _ in range(20))}{line}{' '.join(word('abcd') for _ in range(20))}") for j in range(150)]
    rows += [(2000 + j, f"{r.random()} {passage} {r.random()}") for j in range(150)]
    return rows + [(1, rows[30][1]), (2000, "x" * 200), (2000, "x" * 200), (2001, passage), (None, passage), (5, "x" * 300 + "y"), (6, None)]


@pytest.mark.parametrize("in_range", [20_000, 3])
def test_substring_dedup(spark, in_range):
    rows = skewed()
    raw = [(i, words(t)) for i, t in rows]
    want = [(str(i), len(w), sum(m), hashlib.sha256(" ".join(x for x, g in zip(w, m) if not g).encode()).hexdigest()) for (i, w), m in zip(raw, brute_rows(raw, 50))]
    got = substring_dedup.dedup_words(table(spark, rows).repartition(5), in_range=in_range).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 1000
    assert substring_dedup.dedup_words(table(spark, [])).count() == 0


def test_paths_of_pieces(spark):
    """Pieces follow each other to one head; a branch, another source or a gap begins a new path."""
    pieces = [(1, 0, 10 * k, 10, k, k + 1) for k in range(20)] + [(1, 0, 200, 5, 99, 100), (2, 0, 0, 3, 20, 21), (3, 0, 0, 4, 5, 50)]
    got = {(r._id, r.start): r.head for r in substring_dedup._paths(spark.createDataFrame(pieces, "_id long, _key long, start long, n long, left long, right long")).collect()}
    # node 5 has two ways on, so the path that begins at 0 ends there
    assert got == {**{(1, 10 * k): 0 if k < 5 else 50 for k in range(20)}, (1, 200): 200, (2, 0): 0, (3, 0): 0}


@pytest.mark.parametrize("in_range", [150_000, 30])
def test_suffix_dedup(spark, in_range):
    rows = skewed()
    raw = [(i, (t or "").encode()) for i, t in rows]
    want = []
    for (i, x), m in zip(raw, brute_rows(raw, 50)):
        spans = sum(g and not (j and m[j - 1]) for j, g in enumerate(m))
        want.append((str(i), len(x), sum(m), spans, hashlib.sha256(bytes(c for c, g in zip(x, m) if not g)).hexdigest()))
    got = suffix_dedup.dedup_bytes(table(spark, rows).repartition(5), in_range=in_range).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 10_000
    assert suffix_dedup.dedup_bytes(table(spark, [])).count() == 0


def test_multikey_order_is_the_order_of_bytes():
    import numpy as np

    r = random.Random(2)
    data = bytes(r.choice(b"\0ab") for _ in range(3000)) + b"ab" * 200 + bytes(64)
    at = np.array([r.randrange(len(data) - 80) for _ in range(2000)])
    for length in (3, 8, 20, 50):
        order, new = suffix_dedup.alike(suffix_dedup.eights(np.frombuffer(data, np.uint8)), at, length)
        said = [data[p : p + length] for p in at[order]]
        assert said == sorted(said) and new.tolist() == [k == 0 or said[k] != said[k - 1] for k in range(len(said))]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    rows = corpus() + [(1000, "Hello <|endoftext|> it's 12,5　x" * 50), (1001, "x" * 5000)]
    t = Tokenizer.from_file(token_counts.vocabulary_path())
    for r in token_counts.count_tokens(table(spark, rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.choice([0, 1, 10, 100, 300]), "en", r.choice(["a", "b", "c", "d", None, "a"]), 0, 0, "", "") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(df, block=64).collect()
    assert len(got) == 600
    size = defaultdict(int)
    for row in rows:
        size[row[3]] += len(row[1].split())
    names = sorted((s for s in size if s), key=str) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in full)) / max(1, sum(weight[s] for s in size if s not in full))
        above = {s for s in size if s not in full and weight[s] * level > 2 * size[s]}
        if not above:
            break
        full |= above
    taken = defaultdict(int)
    for x in got:
        assert x.source_size == size[x.source] and 0 <= x.taken <= 2 * x.size
        assert x.target == pytest.approx(2 * size[x.source] if x.source in full else weight[x.source] * level)
        taken[x.source] += x.taken
    for s in size:
        target = 2 * size[s] if s in full else weight[s] * level
        assert abs(taken[s] - target) <= 300
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(7), block=64).collect()))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_decontaminate(spark):
    r = random.Random(9)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [(k, text(35)) for k in range(20)]
    dirty, docs = {}, []
    for i in range(120):
        body = text(150)
        if i % 3 == 0:
            k = r.randrange(20)
            x = list(items[k][1])
            for _ in range(len(x) // 20):  # a twentieth of the characters edited
                x[r.randrange(len(x))] = r.choice("xyz")
            body = f"{text(30)} {''.join(x).upper()}\n{body}"
            dirty[i] = k
        docs.append((i, body))
    docs += [(500, None), (501, ""), (502, "a")]
    found = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {x.doc_id: x.item_id for x in found.collect() if x.contaminated}
    assert got.keys() <= dirty.keys() and len(got) >= 0.9 * len(dirty)
    assert all(dirty[i] == k for i, k in got.items())
    blocks = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000)
    assert {x.doc_id for x in blocks.collect() if x.contaminated} == got.keys()


def test_decontaminate_finds_short_items_and_a_fifth_edited(spark):
    r = random.Random(12)
    lengths = (3, 8, 17, 23, 35, 47, 71, 120, 209, 359)
    text = lambda m: "".join(r.choice("abcdefghij   ") for _ in range(2 * m + 20)).strip()
    items = [(100 * n + j, " ".join(text(m).split())[:m].rstrip().ljust(m, "k")) for n, m in enumerate(lengths) for j in range(12)]
    noise = lambda: "".join(r.choice("qrstuvwxyz  ") for _ in range(150))
    docs = []
    for i, t in items:
        edited = list(t)
        for p in sorted(r.sample(range(len(t)), len(t) // 5), reverse=True):
            edited[p : p + 1] = r.choice(["", "z", "y", edited[p] + "x"])
        docs += [(i, f"{noise()} {t} {noise()}"), (10_000 + i, f"{noise()} {''.join(edited)} {noise()}")]
    rows = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {x.doc_id for x in rows if x.contaminated}
    near = {i for i, t in docs if i >= 10_000 and (m := dict(items)[i - 10_000]) and 5 * decontaminate.edit_distance(m.encode(), " ".join(t.split()).encode()) <= len(m)}
    lost = lambda ids: {n: len([i for i in ids if i % 10_000 // 100 == n and i not in found]) for n in range(len(lengths))}
    assert set(lost([i for i, _ in items]).values()) == {0}
    assert len(near) >= 100 and len(near - found) <= 0.02 * len(near), lost(near)


def test_edit_distance():
    r = random.Random(3)

    def slow(p, t):
        row = [0] * (len(t) + 1)
        for j, a in enumerate(p):
            new = [j + 1]
            for k, b in enumerate(t):
                new.append(min(row[k] + (a != b), row[k + 1] + 1, new[k] + 1))
            row = new
        return min(row)

    for _ in range(200):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randint(1, 30))) for _ in range(2))
        assert decontaminate.edit_distance(p, t) == slow(p, t)


def test_language_id(spark):
    r = random.Random(5)
    alphabet = {"aa": "abc", "bb": "xyz"}
    rows = [(i, " ".join("".join(r.choice(alphabet[l]) for _ in range(5)) for _ in range(30)), l, "s", 0, 0, "", "") for i in range(120) for l in [r.choice(["aa", "bb"])]]
    rows += [(900, None, "aa", "s", 0, 0, "", ""), (901, "12 34", "bb", "s", 0, 0, "", "")]
    got = {x.doc_id: x for x in language_id.identify_languages(spark.createDataFrame(rows, SCHEMA), steps=120).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und"
    held = [x for x in rows[:120] if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert all(got[x[0]].held_out for x in held)
    assert sum(got[x[0]].lang_pred == x[2] for x in held) >= 0.95 * len(held)
    assert language_id.identify_languages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_id_learns_from_whole_texts_and_rare_languages(spark):
    r = random.Random(7)
    noise = "0123 456 " * 4000  # what tells the language stands far behind the beginning
    rows = [(i, noise + " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(300)), l, "s", 0, 0, "", "") for i in range(60) for l, a in [r.choice([("aa", "abc"), ("bb", "xyz")])]]
    rows += [(500 + i, "".join(r.choice("mnop ") for _ in range(400)), "rare", "s", 0, 0, "", "") for i in range(3)]
    got = {x.doc_id: x for x in language_id.identify_languages(spark.createDataFrame(rows, SCHEMA), steps=150).collect()}
    held = [x for x in rows[:60] if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert sum(got[x[0]].lang_pred == x[2] for x in held) >= 0.9 * len(held)
    assert [got[500 + i].lang_pred for i in range(3)] == ["rare"] * 3


def test_network_equals_a_plain_convolution():
    import numpy as np

    net = language_id.Network(3)
    x = language_id.windows("Ein Satz, der länger ist als nichts. ".encode() * 12)
    quick = language_id.log_probabilities(x, net.tables(), net.out, net.out_bias)
    for j, w in enumerate(x):
        e = net.embed[w]
        pooled = [max(float((e[p : p + n, :, None] * c[:, :, [f]]).sum() + b[f]) for p in range(len(w) - n + 1)) for n, c, b in zip(language_id.WIDTHS, net.conv, net.bias) for f in range(language_id.FILTERS)]
        s = np.maximum(pooled, 0) @ net.out + net.out_bias
        assert np.allclose(quick[j], s - np.log(np.exp(s).sum()), atol=1e-3)


def test_toxicity_behind_disguises(spark):
    r = random.Random(6)
    clean = ["the", "cat", "sat", "with", "some", "milk", "and", "bread", "under", "table", "house", "green"]
    bad = ["idiot", "moron", "loser"]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(clean) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            w.insert(5, r.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 0, 0, "", ""))
        labels.append((i, 1, int(toxic)))
    hidden = {5000: "the 1d10t sat", 5001: "some m o r o n under the table", 5002: "green loooser house", 5003: "a L.0.5.3.R here"}
    rows += [(i, t, "en", "s", 0, 0, "", "") for i, t in hidden.items()] + [(6000, None, "en", "s", 0, 0, "", ""), (6001, "the cat has 10 green 1st places", "en", "s", 0, 0, "", "")]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(df, lab).collect()}
    assert all(got[i].predicted == t for i, _, t in labels)
    assert [got[i].predicted for i in hidden] == [1] * 4
    assert got[6000].predicted == got[6001].predicted == 0
    assert all(x.predicted == 0 for x in toxicity.score_toxicity(df, lab.limit(0)).collect())


def test_toxicity_behind_doubled_letters_edges_and_short_runs(spark):
    r = random.Random(6)
    clean = ["the", "cat", "sat", "with", "some", "milk", "and", "bread", "under", "table", "house", "green"]
    bad = ["idiot", "moron", "scum", "clown", "trash", "ass", "дурак"]
    rows, labels = [], []
    for i in range(800):
        w = [r.choice(clean) for _ in range(30)]
        if i % 4 == 0:
            w.insert(5, bad[i // 4 % len(bad)])
        rows.append((i, " ".join(w), "en", "s", 0, 0, "", ""))
        labels.append((i, 1, int(i % 4 == 0)))
    hidden = ["mooron", "iddiot", "!diot", "|diot", "(lown", "+rash", "as$", "s c u m, and", "a s s", "дурак!", "дурак,", "idiot!"]
    rows += [(5000 + j, f"the cat {t} sat", "en", "s", 0, 0, "", "") for j, t in enumerate(hidden)]
    rows += [(6000 + j, t, "en", "s", 0, 0, "", "") for j, t in enumerate(["the green, house! 1 2 3 (table) a b", "the $5 milk + bread!"])]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.score_toxicity(df, lab).collect()}
    assert [t for j, t in enumerate(hidden) if not got[5000 + j]] == []
    assert got[6000] == got[6001] == 0 and all(got[i] == t for i, _, t in labels)


def test_urls(spark):
    rows = [
        (1, "https://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "http://x.net/en/", "x.net", "/en/", "net/", "block"),
        (3, "http://example.com/de/x?q", "example.com", "/de/x", "example.com/de/", "block"), (4, "https://b.org/fr/#t", "b.org", "/fr/", "org/fr/", "allow"),
        (5, None, "", "", None, "allow"), (6, "nothing", "", "", None, "allow"), (7, "http://c.com/casino/", "c.com", "/casino/", None, "block"),
        (8, "http://c.com/xcasino/", "c.com", "/xcasino/", None, "allow"), (9, "http://c.com/free-poker", "c.com", "/free-poker", None, "block"), (10, "http://c.com/free", "c.com", "/free", None, "allow"),
        (11, "http://d.net", "d.net", "", None, "allow"), (12, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(df).collect()}
    assert got == {r[0]: r[2:] for r in rows}
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    light = {"free": 0.4, "poker": 0.4, "casino": 0.3}
    weighed = {x.page_id: (x.verdict, x.weight) for x in url_filter.filter_urls(df.unionByName(spark.createDataFrame([(20, "http://c.com/free-poker?casino,casino"), (20, "http://c.com/free-poker-free")], df.schema)), terms=light).where("page_id in (9, 20)").collect()}
    assert weighed[9] == ("allow", 0.8) and weighed[20] in (("block", 1.1), ("allow", 0.8))


def test_url_vocabulary_is_a_file(tmp_path):
    (tmp_path / "v.tsv").write_text("# note\nbad\t1\nodd\t0.25\n")
    terms = url_filter.vocabulary(tmp_path / "v.tsv")
    assert terms == {"bad": 1.0, "odd": 0.25}
    assert url_filter.count_terms(["x/bad.bad/odd", None, "badodd", "ODD"], terms) == [(2, 1, 1.25), (0, 0, 0.0), (0, 0, 0.0), (0, 1, 0.25)]
    (tmp_path / "v.tsv").write_text("not ok\t1\n")
    with pytest.raises(ValueError):
        url_filter.vocabulary(tmp_path / "v.tsv")


def test_toxicity_by_distinct_token_equals_the_plain_path():
    import numpy as np

    from dossier.llm import toxicity as T

    texts = ["", "plain words here, plain words", "k i l l y o u n o w", "a a a a a b", "x y z w " * 5, "id1ot 1d10t s t u p i d", "Ünïcode wörds!", "a " * 3000 + "stupid stuuuupid $tup1d"]
    model = np.random.default_rng(1).normal(-3, 1, (32,) * 4).astype(np.float32)
    found = sorted({f for t in texts for w in T.Reader(model).read(t) for f in T.features(w)})
    scorer = T.Scorer({f: (k % 7 - 2) / 2 for k, f in enumerate(found)}, (-2.0, 0.5, 0.5))
    plain, quick = T.Reader(model), T.TokenScorer(scorer, model, most=3)
    assert [quick.signals(t) for t in texts] == [scorer.signals(plain.read(t)) for t in texts]
