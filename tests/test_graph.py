"""Graph queries read their answers once, with the same results."""

import json

import pytest

from dossier.operators import graph
from dossier.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def reads(df) -> int:
    """Leaves of the plan: how many tables it reads, each time anew."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def answers(spark, *raw):
    return spark.createDataFrame([("d", k, "s", k, r) for k, r in enumerate(raw)], "doc_id string, source_page int, sector string, seq long, raw string")


TRIPLE, EVENT = {"Head": " Pier ", "Relation": "on", "Tail": "pile"}, {"Event": "pour", "Entity": ["PIER", "crew"]}


def test_concept_batches_read_once(spark):
    triples = graph.parse_triples(answers(spark, json.dumps({"triples": [TRIPLE], "events": [EVENT]})))
    got = graph.concept_batches(triples)
    assert reads(got) == 1 and sorted(r.item for r in got.collect()) == ["crew", "on", "participates in", "pier", "pile", "pour"]


def test_answers_are_not_read_in_joins(spark):
    """A generator's input must not be tested for rows as a join's condition, which reads every answer once more."""
    plan = QUERIES["concept_batches"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "from_json" in line]


@pytest.mark.parametrize("triples, events, heads", [('"x"', json.dumps([EVENT]), ["PIER", "crew"]), (json.dumps([TRIPLE]), '{"Event": 1}', ["Pier"]), (json.dumps([TRIPLE, None]), json.dumps([{"Event": "e"}, {"Event": "f", "Entity": [None, "z"]}]), ["Pier", "z"]), ("null", "null", [])])
def test_one_odd_list_leaves_the_other(spark, triples, events, heads):
    raw = f'{{"triples": {triples}, "events": {events}}}'
    assert sorted(r.head for r in graph.parse_triples(answers(spark, raw, "no answer", None, "[]")).collect()) == heads


def test_cut_answers_say_as_much_as_their_lists_alone(spark):
    raw = json.dumps({"triples": [TRIPLE], "events": [{"Event": "e", "Entity": None}, {"Event": "f", "Entity": ["z"]}]})
    assert graph.parse_triples(answers(spark, raw[: raw.rindex("[")])).count() == 0


def test_stats_read_once(spark):
    triples = graph.parse_triples(answers(spark, json.dumps({"triples": [TRIPLE, TRIPLE, TRIPLE | {"Relation": "near"}], "events": [EVENT]}), json.dumps({"triples": [TRIPLE | {"Head": "PIER"}]})))
    concepts = spark.createDataFrame([("Metro", "d", ["x", "y"]), ("Metro", "e", ["z"])], "sector string, doc_id string, concepts array<string>")
    got = graph.kg_stats(triples, concepts)
    assert reads(got) == 2 and {tuple(r) for r in got.collect()} == {("d", 4, 4, 2), ("e", 0, 0, 1)}


def test_nodes_read_once(spark):
    triples = graph.parse_triples(answers(spark, json.dumps({"triples": [TRIPLE | {"Tail": "PIER"}], "events": [EVENT]}), json.dumps({"events": [{"Event": "CREW", "Entity": ["Pour"]}]})))
    got = graph.kg_nodes(triples)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert reads(got) == 1 and {tuple(r) for r in got.collect()} == {("d", "d::pier", "Pier", "entity"), ("d", "d::crew", "crew", "event"), ("d", "d::pour", "pour", "entity")}
    assert [line for line in plan if "HashAggregate" in line] and len([line for line in plan if "SortAggregate" in line]) == 2  # only spellings are sorted


def test_triples_read_once(spark):
    got = graph.parse_triples(answers(spark, json.dumps({"triples": [TRIPLE], "events": [EVENT]})))
    assert reads(got) == 1 and sorted((r.seq, r.head, r.relation, r.tail, r.triple_type) for r in got.collect()) == [(0, "Pier", "on", "pile", "entity_relation"), (500, "PIER", "participates in", "pour", "event_entity"), (501, "crew", "participates in", "pour", "event_entity")]


def test_edge_strings_read_once(spark):
    got = graph.edge_strings(graph.parse_triples(answers(spark, json.dumps({"triples": [TRIPLE], "events": [EVENT]}))))
    assert reads(got) == 1 and sorted(r.triple_string for r in got.collect()) == ["PIER participates in pour", "Pier on pile", "crew participates in pour"]


def test_edges_read_once(spark):
    got = graph.kg_edges(graph.parse_triples(answers(spark, json.dumps({"triples": [TRIPLE]}), json.dumps({"triples": [TRIPLE | {"Head": "PIER"}]}))))
    assert reads(got) == 1 and [tuple(r) for r in got.collect()] == [("d", "d::pier", "on", "d::pile", 1000, 1, "entity_relation")]
