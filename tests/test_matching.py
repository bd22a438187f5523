"""Matching, completeness, scoring and report rows with expectations written out."""

import math

import pytest

from dossier import fixed
from dossier.operators import checks, graph, hooks, matching, report

FACT = "fact_id string, doc_id string, sector string, fact_type string, subject string, attribute string, value string, unit string, context string, confidence double, source_page int"
RULE = "rule_id string, seq int, standard_name string, clause string, attribute string, operator string, threshold string, unit string, cond string, severity string"


def facts(spark, *rows):
    return spark.createDataFrame([(f"f{k}", r.get("doc", "d"), r.get("sector", "Ports"), r.get("type", "m"), r.get("subject", "pier a"), r.get("attribute", "span"), r.get("value", "5"), r.get("unit", "m"), r.get("context"), r.get("confidence", 0.9), k) for k, r in enumerate(rows)], FACT)


def rules(spark, *rows):
    r = spark.createDataFrame([(f"r{k}", k, r.get("standard", "S"), r.get("clause", "1"), r.get("attribute", "span"), r.get("operator", ">="), r.get("threshold", "4"), "m", r.get("cond"), r.get("severity", "HIGH")) for k, r in enumerate(rows)], RULE)
    return r, spark.createDataFrame([(f"r{k}", s) for k, x in enumerate(rows) for s in x.get("sectors", ("Ports",))], "rule_id string, sector string"), spark.createDataFrame([(s, s) for s in fixed.SECTORS], "sector string, applies string")


def plane(angle):
    return [math.cos(angle), math.sin(angle)]


def vectors(spark, **angles):
    return spark.createDataFrame([(t.replace("_", " "), plane(a)) for t, a in angles.items()], "text string, embedding array<float>")


def test_conditions_need_the_context(spark):
    f = facts(spark, {"context": "measured at NIGHT"}, {"context": "by day"}, {"context": None})
    pairs = lambda cond: sorted(r.fact_id for r in checks.fact_rule_pairs(f, *rules(spark, {"cond": cond})).collect())
    assert pairs("night") == ["f0"] and pairs("") == pairs(None) == ["f0", "f1", "f2"]


def test_a_rule_of_two_sectors_counts_twice(spark):
    r, s, _ = rules(spark, {"sectors": ("Metro", "Rail Infrastructure")})
    applicable = spark.createDataFrame([("Metro", "Metro"), ("Metro", "Rail Infrastructure")], "sector string, applies string")
    assert checks.fact_rule_pairs(facts(spark, {"sector": "Metro"}), r, s, applicable).count() == 2


def test_rows_say_why(spark):
    rows = checks.compliance_rows(checks.fact_rule_pairs(facts(spark, {"value": "5"}, {"value": "3"}, {"value": "deep"}), *rules(spark, {"attribute": "clear span", "clause": "2.1", "severity": ""}))).orderBy("fact_id").collect()
    assert [r.reason for r in rows] == [
        "The DPR reports span as 5 m, which meets the requirement of at least 4 m per S 2.1.",
        "The DPR reports span as 3 m, but the standard requires at least 4 m per S 2.1. This needs to be corrected.",
        "NEEDS_LLM_REVIEW: The DPR reports span as deep m. The rule requires at least 4 m per S 2.1. The threshold is descriptive and cannot be compared automatically — LLM review required to determine compliance.",
    ]
    assert {(r.check_area, r.category, r.standard, r.severity, r.weight) for r in rows} == {("Clear Span", "S", "S 2.1", "HIGH", 3)}
    assert [r.classification for r in rows] == ["Compliant", "Non-Compliant", "Non-Compliant"] and [r.needs_review for r in rows] == [False, False, True]


ROWS = "row_id string, fact_id string, doc_id string, classification string, category string, severity string, weight int"


def test_scores(spark):
    rows = spark.createDataFrame([("c_1", "a", "d", "Compliant", "IRC", "CRITICAL", 4), ("c_2", "b", "d", "Non-Compliant", "", "HIGH", 3), ("c_3", "c", "d", "Non-Compliant", "IRC", "INFO", 1), ("c_4", "d", "d", "Compliant", None, "ODD", 2)], ROWS)
    assert {tuple(r) for r in checks.by_severity(rows).collect()} == {("CRITICAL", 1, 1, 0, 4, 4), ("HIGH", 1, 0, 1, 3, 0)}
    assert {tuple(r) for r in checks.by_category(rows).collect()} == {("IRC", 2, 1, 1, 50.0), ("Uncategorised", 2, 1, 1, 50.0)}
    two = rows.where("row_id in ('c_1', 'c_2')")
    assert [(r.score, r.verdict, r.total_weight, r.non_compliant_weight) for r in checks.total_score(two).collect()] == [(57.1, "NEEDS IMPROVEMENT", 7, 3)]
    assert [(r.score, r.verdict, r.total) for r in checks.total_score(rows.limit(0)).collect()] == [(0.0, "NO_CHECKS_RUN", 0)]
    got = report.document_scores(two, spark.createDataFrame([("d", "Ports"), ("e", "Metro")], "doc_id string, sector string")).collect()
    assert {(r.doc_id, r.weighted_score, r.verdict) for r in got} == {("d", 57.1, "NEEDS IMPROVEMENT"), ("e", 0.0, "NO_CHECKS_RUN")}


def test_cleanup_leaves_table_rows_and_untyped_facts(spark):
    f = facts(spark, {"confidence": 0.4499}, {"confidence": 0.45}, {"confidence": 0.9}, {"type": "table_row", "confidence": 0.1}, {"type": "table_row", "confidence": 0.1}, {"type": None, "confidence": 0.1}, {"type": None, "confidence": 0.1}, {"confidence": None, "subject": "x"})
    got = checks.clean_facts(f)
    assert sorted(r.fact_id for r in got.collect()) == ["f2", "f3", "f4", "f5", "f6", "f7"]
    assert sorted(r.fact_id for r in checks.clean_facts(got).collect()) == ["f2", "f3", "f4", "f5", "f6", "f7"]


@pytest.mark.parametrize("cosine,matched", [(0.8201, True), (0.8199, False)])
def test_second_pass_needs_a_near_text(spark, cosine, matched):
    f = facts(spark, {"attribute": "axle", "subject": "load"}, {"attribute": "axle", "subject": "load"}, {"attribute": "other", "subject": "x"}, {"attribute": "axle", "subject": "load", "doc": "e"})
    v = vectors(spark, axle_load=0.0, draught=math.acos(cosine), other_x=2.0)
    unmatched = spark.createDataFrame([("d", "r1", "draught"), ("d", "r2", "no vector"), ("e", "r1", "draught")], "doc_id string, rule_id string, attribute string")
    got = {(r.doc_id, r.fact_id, r.rule_id, round(r.score, 3)) for r in matching.second_pass(f, unmatched, v).collect()}
    assert got == ({("d", "f0", "r1", 0.82), ("e", "f3", "r1", 0.82)} if matched else set())


@pytest.mark.parametrize("cosine,let", [(0.8001, True), (0.7999, False)])
def test_gate(spark, cosine, let):
    f = facts(spark, {"attribute": "axle", "subject": "load"}, {"attribute": "axle", "subject": "load", "type": "table_row"})
    edges = spark.createDataFrame([(1, plane(math.acos(cosine))), (2, plane(3.0)), (3, [0.0, 0.0])], "vec_id int, embedding array<float>")
    got = [(r.fact_id, round(r.similarity, 2)) for r in matching.gated_facts(f, vectors(spark, axle_load=0.0), edges).collect()]
    assert got == ([("f0", 0.8)] if let else [])


def test_overlap(spark):
    rule = spark.createDataFrame([("s", "a", "total cost of work", 1), ("s", "b", "design speed", 2), ("s", "c", "Design Speed", 3), ("s", "d", "speed design limit now", 4), ("t", "e", "cost", 5)], "sector string, rule_id string, attribute string, seq int")
    asked = spark.createDataFrame([("s", "cost per km"), ("s", "design speed"), ("s", "x cost"), ("t", "cost per km run"), ("s", "none"), ("t", "a b c cost e")], "sector string, attribute string")
    got = {(r.sector, r.attribute): (r.rule_id, round(r.overlap, 3)) for r in matching.overlapping_rule(asked, rule).collect()}
    # of equal attributes the last rule counts; an overlap of exactly a quarter passes, a fifth does not
    assert got == {("s", "design speed"): ("c", 1.0), ("t", "cost per km run"): ("e", 0.25)}


def test_merge(spark):
    rows = spark.createDataFrame([("1", "d", "r1", "f1")], "row_id string, doc_id string, rule_id string, fact_id string")
    more = spark.createDataFrame([("2", "d", "r1", "f0"), ("3", "d", "r2", "f9"), ("4", "d", "r2", "f3"), ("5", "e", "r1", "f7")], rows.schema)
    assert sorted(r.row_id for r in matching.merge_by_rule(rows, more).collect()) == ["1", "4", "5"]


def test_completeness(spark):
    f = facts(spark, {"attribute": "line speed"}, {"attribute": "volume", "subject": "of embankment"}, {"attribute": "flood level"}, {"attribute": "axle", "subject": "x"}, {"attribute": "scour", "type": "table_row"})
    docs = spark.createDataFrame([("d", "Metro")], "doc_id string, sector string")
    asked = ["design speed", "embankment volume", "HFL", "hfl", "load", "far", "scour depth", "Design Speed "]
    parameters = spark.createDataFrame([("Rail Infrastructure" if k % 2 else "Metro", "E", k, p) for k, p in enumerate(asked)], "sector string, entity string, k int, parameter string")
    applicable = spark.createDataFrame([("Metro", "Metro"), ("Metro", "Rail Infrastructure")], "sector string, applies string")
    v = vectors(spark, axle_x=0.0, load=math.acos(0.7801), far=math.acos(0.7799))
    got = sorted(r.parameter for r in matching.completeness(f, docs, parameters, applicable, v).collect())
    # HFL and hfl are one parameter, under the name of the sector itself, whose synonyms are looked up as written
    assert got == ["HFL", "far", "scour depth"]


def test_topk_ties_blocks_and_zero_vectors(spark):
    items = spark.createDataFrame([(k, [1.0, 0.0] if k % 2 else [0.0, 0.0]) for k in range(50)], "vec_id long, embedding array<float>")
    probes = spark.createDataFrame([(100, [2.0, 0.0]), (101, [0.0, 0.0]), (102, [0.0, 1.0])], "vec_id long, embedding array<float>")
    for numbers in (1 << 22, 2):
        got = {}
        for r in checks.vector_topk(items, probes, 3, probe_numbers=numbers).orderBy("probe_id", "rank").collect():
            got.setdefault(r.probe_id, []).append((r.item_id, r.score, r["rank"]))
        assert got == {100: [(1, 1.0, 1), (3, 1.0, 2), (5, 1.0, 3)], 101: [(0, 0.0, 1), (1, 0.0, 2), (2, 0.0, 3)], 102: [(0, 0.0, 1), (1, 0.0, 2), (2, 0.0, 3)]}
    assert checks.vector_topk(items, probes.limit(0), 3).count() == 0


def test_report_order_numbers_every_row(spark):
    rows = spark.createDataFrame([(f"c_{k * 7919 % 4096:03x}{k}", "Compliant" if k % 3 else "Non-Compliant", ("LOW", "CRITICAL", "ODD", "HIGH", "INFO")[k % 5]) for k in range(200)], "row_id string, classification string, severity string")
    got = report.report_order(rows).orderBy("idx").collect()
    order = {s: k for k, s in enumerate(fixed.SEVERITIES)}
    assert [r.idx for r in got] == list(range(1, 201))
    keys = [(r.classification != "Non-Compliant", order.get(r.severity, 5), r.row_id) for r in got]
    assert keys == sorted(keys)


def test_verdicts_override_only_failures(spark):
    rows = spark.createDataFrame([("1", "Non-Compliant", "HIGH", "a", 3), ("2", "Compliant", "HIGH", "b", 3), ("3", "Non-Compliant", "LOW", "c", 1), ("4", "Non-Compliant", "LOW", "d", 1)], "row_id string, classification string, severity string, reason string, weight int")
    said = spark.createDataFrame([("1", "Compliant", "CRITICAL", " fine "), ("2", "Non-Compliant", "LOW", "no"), ("3", "Maybe", "INFO", " ")], "row_id string, classification string, severity string, reason string")
    got = {r.row_id: (r.classification, r.severity, r.reason, r.weight) for r in hooks.with_verdicts(rows, said).collect()}
    assert got == {"1": ("Compliant", "CRITICAL", "fine", 4), "2": ("Compliant", "HIGH", "b", 3), "3": ("Non-Compliant", "LOW", "c", 1), "4": ("Non-Compliant", "LOW", "d", 1)}


def test_nodes_take_their_first_mention(spark):
    t = spark.createDataFrame([("d", 1, "s", 1, '{"triples": [{"Head": "Pier", "Relation": "on", "Tail": "pile"}, {"Head": "", "Relation": "on", "Tail": "x"}, {"Head": "a", "Relation": null, "Tail": "x"}], "events": [{"Event": "pour", "Entity": ["PIER", " ", "crew"]}]}'), ("d", 2, "s", 2, "[]"), ("d", 3, "s", 3, None)], "doc_id string, source_page int, sector string, seq long, raw string")
    triples = graph.parse_triples(t)
    assert sorted((r.head, r.relation, r.tail) for r in triples.collect()) == [("PIER", "participates in", "pour"), ("Pier", "on", "pile"), ("crew", "participates in", "pour")]
    assert {(r.entity_id, r.label, r.node_type) for r in graph.kg_nodes(triples).collect()} == {("d::pier", "Pier", "entity"), ("d::pile", "pile", "entity"), ("d::pour", "pour", "entity"), ("d::crew", "crew", "event")}


def test_table_row_json(spark):
    import hashlib
    import json

    row = {"b": 'say "x"\n', "a": None, "ü": "y\\"}
    df = spark.createDataFrame([("doc", 2, 5, row, "Metro")] * 2, "doc_id string, page int, row_index int, row map<string,string>, sector string")
    got = graph.table_row_facts(df).collect()
    said = json.dumps(row, sort_keys=True, ensure_ascii=False)
    assert [r.value for r in got] == [said] and got[0].fact_id == "tr_" + hashlib.md5(f"doc_2_5_{said}".encode()).hexdigest()[:16]


def test_rule_sectors_accumulate(spark):
    rules_ = spark.createDataFrame([("a", 1, "S", "1", "x"), ("b", 2, "S", "1", "x"), ("c", 3, "S", "2", "x")], "rule_id string, seq int, standard_name string, clause string, attribute string")
    edges = spark.createDataFrame([("a", "Metro"), ("b", "Ports"), ("b", "Metro"), ("c", "Ports")], "rule_id string, sector string")
    assert {tuple(r) for r in checks.rule_sector_edges(rules_, edges).collect()} == {("a", "Metro"), ("a", "Ports"), ("c", "Ports")}
