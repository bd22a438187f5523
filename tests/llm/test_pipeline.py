"""The pipeline's stages against brute force, on a table with nulls, repeated ids, repeated rows and clashing columns."""

import random

import corpus_pipeline
from dossier.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, doc string, size string, copies int"


def rows():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    texts = [" ".join(word() for _ in range(r.choice([3, 40, 200]))) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(1, texts[5]), (1, "something of its own under a used id"), (2, texts[1]), (None, texts[3]), (None, texts[3]), (None, "without id"), (None, "without id"), (50, None), (51, ""), (52, texts[9].upper())]
    changed = max(texts, key=len).split()
    out += [(60, " ".join([*changed, "more"])), (61, texts[39]), (61, texts[39])]
    return [(i, t, "en", r.choice(["a", "b", None]), len(t or ""), 7, "x", "y", 3) for i, t in out]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = lower(t).split()
    return set(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def test_exact_and_near_stages_lose_no_text(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    exact = corpus_pipeline.exact(spark, docs, "")
    assert exact.columns == docs.columns
    kept = exact.collect()
    texts = [lower(x.text) for x in kept]
    assert len(texts) == len(set(texts)) and set(texts) == {lower(x[1]) for x in rows()}
    near = corpus_pipeline.near(spark, common.materialize(exact, "exact"), "")
    assert near.columns == docs.columns
    left = [x.text for x in near.collect()]
    sets = [shingles(x.text) for x in kept]
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    # each text that is gone reaches one that stays; those that stay do not link
    stays = [shingles(t) for t in left]
    assert not any(link(a, b) for k, a in enumerate(stays) for b in stays[:k])
    assert all(any(a == b or link(a, b) for b in stays) for a in sets) and len(left) < len(kept)


def test_mix_stage_carries_texts(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = corpus_pipeline.mix(spark, docs, "").collect()
    assert sorted((x.text or "", x.size, x["copies"]) for x in got) == sorted((x[1] or "", x[7], x[8]) for x in rows())
    assert all(x.mix_size == len((x.text or "").split()) and x.taken == x.mix_copies * x.mix_size for x in got)


def test_empty_tables_pass(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mix):
        assert stage(spark, docs, "").count() == 0


def test_whole_run(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leaked = max((x[1] or "" for x in rows()[:12]), key=len)
    spark.createDataFrame([(1, leaked), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert leaked not in {x.text for x in got} and len(got) >= 40
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing"]
