"""Readers, sinks and hooks on files in a temporary folder."""

import io
import json
import zipfile

import pytest

from dossier.operators import hooks
from dossier.sources import readers, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("First") + p(" ") + p("Second") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b ')}</w:tc></w:tr><w:tr><w:tc>{p('c')}</w:tc><w:tc>{p('')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_pages_of_text_and_docx(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("héllo\n".encode() + b"\xff x")
    (tmp_path / "a.DOCX").write_bytes(docx())
    got = {r.doc_id: r for r in readers.read_pages(spark, str(tmp_path)).collect()}
    assert got["b"].text == "héllo\n� x" and not got["b"].has_table
    assert got["a"].text == "First\nSecond\n\n[TABLE 1]\na | b\nc | \n[/TABLE]\n" and got["a"].has_table
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    pages = lambda data: [{"text": "Schedule of rates", "lines": 9}, {"text": "x" * 100, "rect_count": 7}, {"text": None}]
    got = [(r.page_num, r.is_scanned, r.has_table, r.has_grid_lines) for r in readers.read_pages(spark, str(tmp_path), pdf=pages).where("doc_id = 'c'").orderBy("page_num").collect()]
    assert got == [(0, True, True, True), (1, False, True, False), (2, True, False, False)]
    with pytest.raises(Exception, match="no reader for PDF"):
        readers.read_pages(spark, str(tmp_path)).collect()
    (tmp_path / "d.xls").write_bytes(b"x")
    with pytest.raises(Exception, match="Unsupported document type"):
        readers.list_documents(spark, str(tmp_path)).collect()


def test_extraction_files(spark, tmp_path):
    for d, files in {"doc1": {"metadata.json": {"doc_id": "doc1", "sector": "Metro", "total_pages": 3}, "facts_raw.json": [{"subject": "pier", "value": "5", "confidence": "0.7"}, {"attribute": "span"}], "tables_raw.json": {"4": [{"a": "1", "b": None}, {"a": "2"}], "6": []}}, "doc2": {"rules_raw.json": [{"attribute": "span", "rule_text": "x"}]}}.items():
        (tmp_path / d).mkdir()
        for name, value in files.items():
            (tmp_path / d / name).write_text(json.dumps(value))
    got = readers.read_extraction(spark, str(tmp_path))
    assert [(r.doc_id, r.sector, r.total_pages, r.filename) for r in got["metadata"].collect()] == [("doc1", "Metro", 3, None)]
    assert sorted((r.subject or "", r.value or "", r.confidence or "", r.attribute or "") for r in got["facts"].collect()) == [("", "", "", "span"), ("pier", "5", "0.7", "")]
    assert sorted((r.doc_id, r.page, r.row_index, dict(r.row)) for r in got["tables"].collect()) == [("doc1", 4, 0, {"a": "1", "b": None}), ("doc1", 4, 1, {"a": "2"})]
    assert [r.attribute for r in got["rules"].collect()] == ["span"]
    assert readers.find_file(spark, "metadata.json", f"{tmp_path}/doc2", f"{tmp_path}/doc1").endswith("doc1/metadata.json")
    assert readers.find_file(spark, "nothing", str(tmp_path)) is None
    (tmp_path / "seeds.json").write_text(json.dumps([{"standard_name": "S", "sector": "Ports", "rules": [{"attribute": "a"}, {"attribute": "b"}]}]))
    assert sorted((r.standard_name, r.attribute) for r in readers.read_seed_rules(spark, f"{tmp_path}/seeds.json").collect()) == [("S", "a"), ("S", "b")]


def test_stored_tables(spark, tmp_path):
    path = f"{tmp_path}/rule"
    row = lambda *rows: spark.createDataFrame(rows, "seq int, k string, rule_id string, severity string")
    sinks.merge(row((1, "a", "r1", "LOW"), (2, "b", "r2", "LOW"), (3, "a", "r3", "HIGH")), path, ["k"], ("rule_id",))
    got = sinks.merge(row((1, "a", "r4", "CRITICAL"), (2, "c", "r5", "LOW")), path, ["k"], ("rule_id",))
    assert {(r.k, r.rule_id, r.severity) for r in got.collect()} == {("a", "r1", "CRITICAL"), ("b", "r2", "LOW"), ("c", "r5", "LOW")}
    assert sinks.versions(spark, path) == [1, 2] and sinks.load(spark, path).count() == 3
    facts = lambda *rows: spark.createDataFrame(rows, "fact_id string, doc_id string")
    sinks.append_missing(facts(("x", "d"), ("y", "e")), f"{tmp_path}/fact", "fact_id")
    assert sinks.append_missing(facts(("x", "d"), ("z", "d")), f"{tmp_path}/fact", "fact_id").count() == 3
    assert [r.fact_id for r in sinks.forget(spark, f"{tmp_path}/fact", ["d"]).collect()] == ["y"]
    edges = lambda *rows: spark.createDataFrame(rows, "rule_id string, sector string")
    sinks.accumulate(edges(("r", "Metro")), f"{tmp_path}/edge")
    assert sinks.accumulate(edges(("r", "Ports"), ("r", "Metro")), f"{tmp_path}/edge").count() == 2
    sinks.hand_on(spark, f"{tmp_path}/state", "push", doc_id="d")
    assert sinks.hand_on(spark, f"{tmp_path}/state", "engines", doc_id="d", issues=3) == {"push": {"doc_id": "d"}, "engines": {"doc_id": "d", "issues": "3"}}
    sinks.write_report(facts(("x", "d"), ("y", "e")), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").where("doc_id = 'e'").first().fact_id == "y"
    index = sinks.save_index(spark.createDataFrame([(1, "span", [1.0, 0.0])], "vec_id int, label string, embedding array<float>"), f"{tmp_path}/index")
    assert index.first().label == "span"
    assert sinks.show(index.select("vec_id", "label")).split() == ["vec_id", "label", "1", "span"]


def test_pages_that_were_worked_on(spark):
    pages = spark.createDataFrame([("d", k) for k in range(4)], "doc_id string, page_num int")
    cache = spark.createDataFrame([("d", 1, None), ("d", 1, "x"), ("e", 2, "x")], "doc_id string, page_num int, raw string")
    new, old = sinks.uncached(pages, cache)
    assert sorted(r.page_num for r in new.collect()) == [0, 2, 3] and [r.page_num for r in old.collect()] == [1]
    assert sinks.uncached(pages, None)[0].count() == 4


def test_hooks(spark):
    pages = spark.createDataFrame([("d", 1, "The span is 5 m and the pile is 3 m long"), ("d", 2, "short"), ("d", 3, "no numbers in this longer piece of text")], "doc_id string, page_num int, text string")

    def find(row):
        import re

        return [{"attribute": a, "value": v, "unit": "m", "odd": 1} for a, v in re.findall(r"(\w+) is (\d+)", row["text"])]

    got = hooks.facts_from_pages(pages, find, ["doc_id", "page_num"]).collect()
    assert sorted((r.page_num, r.attribute, r.value, r.subject) for r in got) == [(1, "pile", "3", None), (1, "span", "5", None)]
    assert hooks.facts_from_pages(pages, None, ["doc_id"]).count() == 0
    batches = spark.createDataFrame([("d", f"i{k}", k // 60) for k in range(70)], "doc_id string, item string, batch int")
    labels = {r.item: r.concepts for r in hooks.concepts_of(batches, lambda items: {items[0]: ["x", 3], "other": []} if len(items) == 60 else None).collect()}
    assert len(labels) == 70 and sorted(v for v in labels.values() if v) == [["x"]]

    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[1.0, float(len(t))] for t in texts]

    texts = spark.createDataFrame([("a",), ("a",), ("bb",)], "text string")
    assert sorted((r.text, r.embedding) for r in hooks.vectors_of(texts, embed, 2).collect()) == [("a", [1.0, 1.0]), ("bb", [1.0, 2.0])]
    assert {tuple(r.embedding) for r in hooks.vectors_of(spark.createDataFrame([("bad",)], "text string"), embed, 2).collect()} == {(0.0, 0.0)}


def test_answers_and_routes(spark):
    waits, calls = [], []

    def fails(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert hooks.retried(fails, wait=waits.append)(7) == 7 and waits == [2.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        hooks.retried(lambda: 1 / 0, attempts=2, wait=waits.append)()
    assert [hooks.route(t, {"small": "s", "large": "l"}) for t in ("concept", "extraction", "other")] == ["s", "l", "l"]
    df = spark.createDataFrame([('{"sector": "Ports", "confidence": 0.8}', ' "IRC:37" '), ("no", "")], "a string, b string")
    from pyspark.sql import functions as F

    got = [(r.s.sector, r.s.confidence, r.n) for r in df.select(hooks.sector_of(F.col("a")).alias("s"), hooks.standard_of(F.col("b")).alias("n")).collect()]
    assert got == [("Ports", 0.8, "IRC:37"), ("Rail Infrastructure", 0.1, "Unknown Standard")]


def test_reviews(spark):
    rows = [(f"f{k:02d}", "d" if k < 90 else "e", "m", f"s{k}", 0.9 if k % 2 else 0.5, 100 - k) for k in range(94)]
    facts = spark.createDataFrame(rows, "fact_id string, doc_id string, fact_type string, subject string, confidence double, source_page int")
    seen = lambda fs: [{"description": f"{len(fs)} {fs[0]['fact_id']}"}, {"severity": "HIGH"}, {"description": "x", "severity": "LOW", "evidence": "y"}, 7]
    got = {tuple(r) for r in hooks.consistency_review(facts, seen).collect()}
    assert got == {("d", "llm_flagged", "MEDIUM", "45 f89", ""), ("d", "llm_flagged", "LOW", "x", "y")}  # the other document has too few sure facts
    assert {r.description for r in hooks.anomaly_review(facts, seen).collect()} == {"60 f00", "4 f90", "x"}
    assert hooks.anomaly_review(facts, None).count() == 0


def test_graph_of_pages(spark):
    text = "The pier stands on a pile cap of concrete. " * 300
    pages = spark.createDataFrame([("d", 0, "Metro", text), ("d", 1, "Metro", "short"), ("d", 2, "Metro", "A second page with enough text to be asked about, surely.")], "doc_id string, page_num int, sector string, text string")
    asked = lambda t, sector: json.dumps({"triples": [{"Head": "Pier", "Relation": "on", "Tail": f"cap {len(t) > 100}"}]})
    got = hooks.page_graph(pages, asked, lambda items: {i: [" Structure ", "a label of four words"] for i in items})
    assert got["answers"].groupBy("page_num").count().orderBy("page_num").collect()[0]["count"] > 1
    assert {(r.label, r.node_type) for r in got["nodes"].collect()} == {("Pier", "entity"), ("cap True", "entity"), ("cap False", "entity")}
    assert sorted(r.source_page for r in got["edges"].collect()) == [1, 3]
    assert [(r.name, r.sector) for r in got["concepts"].collect()] == [("structure", "Metro")]
    cache = spark.createDataFrame([("d", 0, "Metro", 0, None)], "doc_id string, page_num int, sector string, chunk int, raw string")
    assert {r.label for r in hooks.page_graph(pages, asked, None, cache)["nodes"].collect()} == {"Pier", "cap False"}
    assert hooks.page_graph(pages, None, None)["triples"].count() == 0
