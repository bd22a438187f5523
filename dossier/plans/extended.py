"""Queries over matching, graph, report, table and source operators, with their DuckDB twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from dossier import fixed
from dossier.functions import expr as E
from dossier.operators import checks, graph, hooks, matching, pages, report, tables
from dossier.plans import catalogue as C
from dossier.sources import adapters as A
from dossier.sources import readers

q, title, key_of, checked, filled = C.q, C.title, C.key_of, C.checked, C.filled


def values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join('NULL' if v is None else str(v) if isinstance(v, (int, float)) else q(v) for v in r) + ')' for r in rows)}) AS t({names})"


def inline(s, rows: list[tuple], schema: str):
    return s.createDataFrame(rows, schema)


# ---- inputs

DOCS = f"docs AS (SELECT * FROM {values(list(A.DOCUMENTS), 'doc_id, sector')})"
VECTORS = f"""vec AS (SELECT text, u FROM (SELECT text, (CAST(regexp_extract(text, '([0-9]+)$', 1) AS INTEGER) * 7 + length(text)) % 500 AS vec_id FROM (SELECT DISTINCT concat_ws(' ', attribute, subject) AS text FROM fact) WHERE regexp_matches(text, '[0-9]$')
 UNION ALL SELECT * FROM {values(list(A.TEXT_VECTORS), 'text, vec_id')}) JOIN uv USING (vec_id))"""
DOT = "round(list_sum(list_transform(range(1, len({a}) + 1), lambda j: {a}[j] * {b}[j])), 9)"
SAID = "said AS (SELECT fact_id, doc_id, trim(concat(attribute, ' ', subject)) AS text FROM meas)"
APPLIED = "applied AS (SELECT DISTINCT a.sector, s.rule_id FROM applicable a JOIN rule_sector s ON s.sector = a.applies)"
UNMATCHED = "unmatched AS (SELECT d.doc_id, r.rule_id, r.attribute FROM docs d JOIN applied USING (sector) JOIN rule r USING (rule_id) WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = d.doc_id AND p.rule_id = r.rule_id))"
SECOND = f"""near AS (SELECT n.doc_id, n.rule_id, t.fact_id, {DOT.format(a='a.u', b='b.u')} AS score FROM unmatched n JOIN vec a ON a.text = n.attribute JOIN said t ON t.doc_id = n.doc_id JOIN vec b ON b.text = t.text),
 second AS (SELECT doc_id, rule_id, fact_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY score DESC, fact_id) AS k FROM near WHERE score >= 0.82) WHERE k = 1)"""
OF_RULE = "r.attribute AS rule_attribute, r.standard_name, r.clause, r.severity, r.operator, r.threshold, r.unit AS rule_unit, NULL::VARCHAR AS applies"
GATE = f"""edge AS (SELECT u FROM uv WHERE vec_id < 20), texts AS (SELECT DISTINCT text FROM said), gate AS (SELECT text, max({DOT.format(a='v.u', b='e.u')}) AS similarity FROM texts JOIN vec v USING (text), edge e GROUP BY text HAVING max({DOT.format(a='v.u', b='e.u')}) >= 0.8),
 lookup AS (SELECT sector, lower(trim(attribute)) AS r_attr, max_by(rule_id, seq) AS rule_id, min(seq) AS place FROM applied JOIN rule USING (rule_id) GROUP BY ALL),
 attrs AS (SELECT DISTINCT sector, attribute, list_distinct(string_split(lower(attribute), ' ')) AS ws FROM meas),
 shared AS (SELECT sector, attribute, rule_id, place, len(list_intersect(ws, rw)) / len(list_distinct(list_concat(ws, rw))) AS overlap FROM attrs JOIN (SELECT *, list_distinct(string_split(r_attr, ' ')) AS rw FROM lookup) USING (sector)),
 best AS (SELECT sector, attribute, rule_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY sector, attribute ORDER BY overlap DESC, place) AS k FROM shared) WHERE k = 1 AND overlap >= 0.25),
 gated AS (SELECT f.fact_id, r.rule_id, g.similarity, b.overlap, f.doc_id, f.sector, f.attribute, f.unit, f.value, f.source_page, {OF_RULE} FROM meas f JOIN said t USING (fact_id) JOIN gate g ON g.text = t.text JOIN best b ON b.sector = f.sector AND b.attribute = f.attribute JOIN rule r ON r.rule_id = b.rule_id)"""
MATCH = f"WITH {C.PAIRS}, {DOCS}, {C.UNITV}, {SAID}, {VECTORS}, {APPLIED}"


def _texts(s, d):
    return A.text_vectors(s, d)


def _unmatched(s, d):
    return matching.unmatched_rules(A.documents(s), A.rules(s), A.rule_sectors(s), A.applicable_sectors(s), C._pairs(s, d).select("doc_id", "rule_id"))


def _second(s, d):
    return matching.second_pass(A.facts(s, d), _unmatched(s, d), _texts(s, d))


def _second_rows(s, d):
    return checks.compliance_rows(matching.second_pass_pairs(A.facts(s, d), A.rules(s), _second(s, d)), "vector")


def _gated(s, d):
    return matching.gate_and_overlap(A.facts(s, d), A.rules(s), A.rule_sectors(s), A.applicable_sectors(s), _texts(s, d), A.rulebook_edges(s, d))


def _merged(s, d):
    both = C._rows(s, d).unionByName(_second_rows(s, d))
    return matching.merge_by_rule(both, checks.compliance_rows(_gated(s, d), "graph"))


ONTOLOGY = f"onto AS (SELECT * FROM {values([(s, e, k, p) for s, e, ps in A.ONTOLOGY for k, p in enumerate(ps)], 'sector, entity, k, parameter')})"
TERMS = "CASE parameter " + " ".join(f"WHEN {q(p)} THEN [{', '.join(map(q, t))}]" for p, t in fixed.PARAMETER_SYNONYMS) + " ELSE CAST([] AS VARCHAR[]) END"
MISSING = f"""asked AS (SELECT doc_id, sector, pkey, parameter, entity FROM (SELECT d.doc_id, d.sector, lower(trim(o.parameter)) AS pkey, o.parameter, o.entity, row_number() OVER (PARTITION BY d.doc_id, lower(trim(o.parameter)) ORDER BY a.applies <> d.sector, a.applies, o.entity, o.k) AS n
  FROM docs d JOIN applicable a USING (sector) JOIN onto o ON o.sector = a.applies) WHERE n = 1),
 terms AS (SELECT *, list_concat([lower(parameter)], {TERMS}) AS ts, string_split(lower(parameter), ' ') AS ws FROM asked),
 lows AS (SELECT DISTINCT doc_id, text, lower(text) AS low FROM said),
 found AS (SELECT DISTINCT doc_id, pkey FROM terms t JOIN lows l USING (doc_id) WHERE len(list_filter(ts, lambda x: contains(low, x))) > 0 OR (len(ws) > 1 AND len(list_filter(ws, lambda x: NOT contains(low, x))) = 0)),
 close AS (SELECT DISTINCT t.doc_id, t.pkey FROM terms t JOIN vec a ON a.text = t.parameter JOIN lows l ON l.doc_id = t.doc_id JOIN vec b ON b.text = l.text WHERE {DOT.format(a='a.u', b='b.u')} >= 0.78)
 SELECT doc_id, sector, parameter, entity, {title('parameter')} AS check_area, concat(entity, ' – Completeness') AS category, 'Non-Compliant' AS classification, 'Not found in DPR' AS dpr_value, 'Parameter must be present' AS rule_expected,
  'DPR Completeness / Ontology' AS standard, 'HIGH' AS severity, 3 AS weight, 0 AS source_page FROM terms t WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = t.doc_id AND f.pkey = t.pkey) AND NOT EXISTS (SELECT 1 FROM close c WHERE c.doc_id = t.doc_id AND c.pkey = t.pkey)"""

TRIPLE = """line AS (SELECT concat('doc', CAST(l_orderkey % 3 AS VARCHAR)) AS doc_id, CAST(l_linenumber AS INTEGER) AS source_page, 'Metro' AS sector, (l_orderkey * 10 + l_linenumber) * 1000 AS s, trim(s_name) AS s_name, p_name, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 101 <> 0),
 triple AS (SELECT doc_id, source_page, sector, s AS seq, s_name AS head, 'supplies' AS relation, p_name AS tail, 'entity_relation' AS triple_type FROM line WHERE l_orderkey % 17 <> 0
  UNION ALL SELECT doc_id, source_page, sector, s + 500 + j, CASE j WHEN 0 THEN s_name ELSE upper(p_name) END, 'participates in', concat('Order ', CAST(l_orderkey % 100 AS VARCHAR)), 'event_entity' FROM line, (VALUES (0), (2)) AS e(j) WHERE source_page = 2)"""
NODES = """ends AS (SELECT doc_id, head AS label, seq * 2 AS o, CASE WHEN triple_type = 'event_entity' THEN 'event' ELSE 'entity' END AS node_type FROM triple UNION ALL SELECT doc_id, tail, seq * 2 + 1, 'entity' FROM triple),
 nodes AS (SELECT doc_id, concat(doc_id, '::', lower(label)) AS entity_id, min_by(label, o) AS label, min_by(node_type, o) AS node_type FROM ends GROUP BY doc_id, concat(doc_id, '::', lower(label)))"""
EDGES = "edges AS (SELECT doc_id, concat(doc_id, '::', lower(head)) AS head_id, relation, concat(doc_id, '::', lower(tail)) AS tail_id, max(seq) AS last_seq, max_by(source_page, seq) AS source_page, max_by(triple_type, seq) AS triple_type FROM triple GROUP BY ALL)"
CONCEPT = """labels AS (SELECT p_partkey AS id, concat('doc', CAST(p_partkey % 3 AS VARCHAR)) AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'Metro' ELSE 'Ports' END AS sector, lower(p_name) AS item, [lower(p_type), lower(p_brand), lower(concat('size ', CAST(p_size AS VARCHAR))), 'item', 'good'] AS concepts FROM part),
 concept AS (SELECT name, sector, max(doc_id) AS doc_id, true AS is_induced FROM (SELECT sector, doc_id, unnest(concepts) AS name FROM labels) GROUP BY name, sector)"""


def _triples(s, d):
    return graph.parse_triples(A.answers(s, d))


def _concepts(s, d):
    return A.concepts(s, d).withColumn("concepts", graph.clean_concepts(F.col("labels"))).drop("labels")


# ---- violations

FLAG_ROWS = {
    "statistical_outlier": "SELECT {id1} AS violation_id, 'anomaly' AS stage, 'statistical_outlier' AS kind, doc_id, severity, attribute FROM x",
    "oom_error": "SELECT {id1} AS violation_id, 'anomaly' AS stage, 'oom_error' AS kind, doc_id, severity, attribute FROM x",
    "duplicate_values": "SELECT {id2} AS violation_id, 'anomaly' AS stage, 'duplicate_values' AS kind, doc_id, severity, attribute FROM x",
    "unit_mismatch": "SELECT {id2} AS violation_id, 'anomaly' AS stage, 'unit_mismatch' AS kind, doc_id, severity, attribute FROM x",
}


def _sub(sql: str) -> str:
    return f"(WITH {C.FACT}, {sql})"


def _flag(kind: str) -> str:
    return FLAG_ROWS[kind].format(id1=key_of("v_", q(kind), "fact_id"), id2=key_of("v_", q(kind), "doc_id", "attribute")).replace("FROM x", f"FROM {_sub(C.FLAG_SQL[kind])}")


VIOLATIONS = (
    "viol AS (" + " UNION ALL ".join(_flag(k) for k in FLAG_ROWS)
    + f" UNION ALL SELECT {key_of('v_', q('numeric_mismatch'), 'doc_id', 'subject', 'attribute')}, 'consistency', 'numeric_mismatch', doc_id, severity, concat(subject, ' → ', attribute) FROM {_sub(C.MISMATCH)}"
    + f" UNION ALL SELECT {key_of('v_', q('missing_dependency'), 'doc_id', 'parameter', 'requires')}, 'consistency', 'missing_dependency', doc_id, severity, parameter FROM {_sub(C.MISSING)})"
)
RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(fixed.SEVERITIES)) + f" ELSE {len(fixed.SEVERITIES)} END"
LINKS = (
    " UNION ALL ".join(f"SELECT {key_of('v_', q(k), 'fact_id')} AS violation_id, fact_id FROM {_sub(C.FLAG_SQL[k])}" for k in ("statistical_outlier", "oom_error"))
    + f" UNION ALL SELECT {key_of('v_', q('duplicate_values'), 'm.doc_id', 'x.attribute')}, m.fact_id FROM meas m JOIN {_sub(C.FLAG_SQL['duplicate_values'])} x ON x.doc_id = m.doc_id AND x.attribute = lower(trim(m.attribute))"
    + f" UNION ALL SELECT {key_of('v_', q('unit_mismatch'), 'm.doc_id', 'x.attribute')}, m.fact_id FROM meas m JOIN {_sub(C.FLAG_SQL['unit_mismatch'])} x ON x.doc_id = m.doc_id AND x.attribute = lower(trim(m.attribute)) WHERE m.unit <> ''"
    + f" UNION ALL SELECT {key_of('v_', q('numeric_mismatch'), 'm.doc_id', 'x.subject', 'x.attribute')}, m.fact_id FROM (SELECT fact_id, doc_id, lower(trim(subject)) AS subject, {C.CANON_ATTR} AS attribute, {C.loose('value')} AS n FROM meas) m JOIN {_sub(C.MISMATCH)} x ON x.doc_id = m.doc_id AND x.subject = m.subject AND x.attribute = m.attribute WHERE m.n IS NOT NULL"
    + f" UNION ALL SELECT {key_of('v_', q('missing_dependency'), 'f.doc_id', 'x.parameter', 'x.requires')}, f.fact_id FROM fact f JOIN {_sub(C.MISSING)} x ON x.doc_id = f.doc_id WHERE contains(lower(f.attribute), lower(x.parameter)) OR contains(lower(f.subject), lower(x.parameter))"
)


def _violations(s, d):
    f = A.facts(s, d)
    return report.issues(f, A.dependencies(s)).unionByName(report.flags(f))


def _counts(stage: str) -> tuple[list, str]:
    kinds = {"consistency": ("numeric_mismatch", "missing_dependency", "llm_flagged"), "anomaly": tuple(k for k, _ in fixed.ANOMALY_LABELS)}[stage]
    cells = [("kind", k) for k in kinds] + [("severity", v) for v in fixed.SEVERITIES[:4]] + [("total", "")]
    one = lambda by, n: f"SELECT '{stage}' AS stage, '{by}' AS \"by\", '{n}' AS name, count(*) FILTER (stage = '{stage}'" + ("" if by == "total" else f" AND {by} = '{n}'") + ") AS n FROM viol"
    return cells, f"WITH {VIOLATIONS} " + " UNION ALL ".join(one(by, n) for by, n in cells)


PAGE_SQL = "CASE WHEN source_page > 0 THEN concat('p.', CAST(source_page AS VARCHAR)) ELSE '—' END"
LABEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.ANOMALY_LABELS) + " ELSE kind END"
REPORTS = [
    ("new", json.dumps({"results": [{"classification": "Compliant", "check_area": "Span", "category": "IRC", "dpr_value": "5 m", "rule_expected": "at least 4 m", "standard": "IRC 1", "severity": "LOW", "weight": 1, "reason": "ok", "source_page": 3}, {"classification": "Non-Compliant", "check_area": "Load", "severity": "CRITICAL", "weight": 4}]})),
    ("old", json.dumps({"findings": {"failures": [{"attribute": "cover", "standard": "IS:456", "dpr_value": "20", "rule": ">= 40", "severity": "CRITICAL", "explanation": "thin", "source_page": 7}, {"attribute": "grade", "standard": "IS:456", "severity": "INFO"}], "missing_parameters": [{"parameter": "hfl", "rule_text": ""}, {"parameter": "scour", "rule_text": "must be given"}]}})),
    ("empty", "{}"), ("two_of_three", json.dumps({"results": [{"classification": "Compliant"}, {"classification": "Compliant"}, {"classification": "Non-Compliant"}]})), ("none", "no json"),
]
LEGACY = [
    ("new", "Compliant", "Span", "IRC", "5 m", "at least 4 m", "IRC 1", "LOW", 1, "ok", 3), ("new", "Non-Compliant", "Load", None, None, None, None, "CRITICAL", 4, None, None),
    ("old", "Non-Compliant", "cover", "IS:456", "20", ">= 40", "IS:456", "CRITICAL", 4, "thin", 7), ("old", "Non-Compliant", "grade", "IS:456", None, None, "IS:456", "INFO", 2, "Does not meet rule requirement.", None),
    ("old", "Non-Compliant", "hfl", "DPR Completeness", "Not found", "Must be present", "DPR Completeness", "HIGH", 3, "Mandatory parameter missing from DPR.", 0), ("old", "Non-Compliant", "scour", "DPR Completeness", "Not found", "Must be present", "DPR Completeness", "HIGH", 3, "must be given", 0),
    ("two_of_three", "Compliant", None, None, None, None, None, None, None, None, None), ("two_of_three", "Compliant", None, None, None, None, None, None, None, None, None), ("two_of_three", "Non-Compliant", None, None, None, None, None, None, None, None, None),
]
LEGACY_SCORES = [("new", 2, 1, 1, 50, "NEEDS IMPROVEMENT"), ("old", 4, 0, 4, 0, "POOR"), ("empty", 0, 0, 0, 0, "POOR"), ("two_of_three", 3, 2, 1, 67, "NEEDS IMPROVEMENT"), ("none", 0, 0, 0, 0, "POOR")]
ANSWERS = [
    (1, '{"b": 1, "a": [2]}'), (2, '```json\n[{"x": 1}]\n```'), (3, 'Here: [1, 2] and more'), (4, '{"a": 1} {"b": {"c": "}"}} tail'), (5, "nothing"), (6, None), (7, '{"a": 1'), (8, '{"a": [1'), (9, '[{"a": 1}, {"b": 2'), (10, 'x {"t": "ü"}'),
]
REPAIRED = [(1, '{"a":[2],"b":1}'), (2, '[{"x":1}]'), (3, "[1,2]"), (4, '[{"a":1},{"b":{"c":"}"}}]'), (5, None), (6, None), (7, None), (8, None), (9, '[{"a":1}]'), (10, '[{"t":"ü"}]')]
HEADERS = [(1, ["Item", None, "Qty", "nan", " Item ", "", "Item"]), (2, ["a", "a", "a_2"]), (3, []), (4, ["None", "col_1"])]
NAMES = [(1, ["Item", "col_2", "Qty", "col_4", "Item_2", "col_6", "Item_3"]), (2, ["a", "a_2", "a_2"]), (3, []), (4, ["col_1", "col_1_2"])]
CELLS = [(1, [["Item", "Qty", "Item"], ["pile", " ", "12"], ["cap", "3", None]]), (2, [["only", "header"]]), (3, [["", "x"], ["1", "2"]])]
CELL_ROWS = [(1, 0, "Item", "pile"), (1, 0, "Qty", None), (1, 0, "Item_2", "12"), (1, 1, "Item", "cap"), (1, 1, "Qty", "3"), (1, 1, "Item_2", None), (3, 0, "col_1", "1"), (3, 0, "x", "2")]
SEEDS = [
    (json.dumps([{"standard_name": "IRC:37", "sector": "Highways", "rules": [{"clause": "3.2.1", "rule_text": "CBR at least 3", "attribute": "subgrade CBR", "operator": ">=", "threshold": "3", "unit": "%", "condition": "", "severity": "CRITICAL"}, {"rule_text": "short", "attribute": "x"}]}, {"standard_name": "IRS", "sector": "Rail Infrastructure", "rules": [{"attribute": "gauge", "rule_text": "gauge must be 1676"}]}]),),
]
SEED_ROWS = [("IRC:37", "Highways", "3.2.1", "CBR at least 3", "subgrade CBR", ">=", "3", "%", "", "CRITICAL"), ("IRC:37", "Highways", None, "short", "x", None, None, None, None, None), ("IRS", "Rail Infrastructure", None, "gauge must be 1676", "gauge", None, None, None, None, None)]
RAW_RULES = [  # seq, rule_id, standard, clause, text, attribute, operator, threshold, unit, condition, severity, sector
    (1, "a1", "IRC:6", "1", "x" * 600, "load", None, "10", None, None, None, "Bridges"), (2, "a2", "IRC:6", "1", "newer text of rule", "load", ">=", "20", "t", "", "LOW", "Highways"),
    (3, "a3", None, None, "a rule without standard", "span", "==", None, "m", "night", "HIGH", ""), (4, "a4", "X", "2", "short", "span", "<", "1", "m", None, "HIGH", "Nowhere"), (5, "a5", "X", "3", "text long enough", " ", "<", "1", "m", None, "HIGH", "Ports"),
]
RULE_FIELDS = "seq long, rule_id string, standard_name string, clause string, rule_text string, attribute string, operator string, threshold string, unit string, condition string, severity string, sector string"
STORED_RULES = [("a1", "IRC:6", "1", "load", "newer text of rule", ">=", "20", "t", "", "LOW"), ("a3", "", "", "span", "a rule without standard", "==", "", "m", "night", "HIGH")]
RULE_EDGES = [("a1", "Bridges"), ("a1", "Highways")]
META = [  # seq, doc_id, filename, doc_type, pages, sector, confidence, scanned, page_range
    (1, "doc0", "a.pdf", None, None, "Metro", None, None, None), (2, "doc1", None, "docx", 3, "Bridges", 0.9, True, "1-3"), (3, "doc0", "b.pdf", "pdf", 12, "Metro", 0.7, False, "8-12"), (4, "doc9", None, None, None, None, None, None, None),
]
META_FIELDS = "seq long, doc_id string, filename string, doc_type string, total_pages int, sector string, sector_confidence double, is_scanned boolean, page_range string"
META_ROWS = [("doc0", "b.pdf", "pdf", 12, "Metro", 0.7, False, "8-12", "b.pdf"), ("doc1", "", "docx", 3, "Bridges", 0.9, True, "1-3", ""), ("doc9", "", "pdf", 0, "", 0.0, False, "", "")]
ONTO = [("doc0", "Metro", 1, json.dumps({"classes": [{"name": "Track", "description": "old", "example_subjects": ["a"]}, {"name": "Track", "description": "new"}], "dependencies": [{"parameter": " pile ", "requires": "soil", "reason": "r"}, {"parameter": "pile", "requires": "soil", "validation_rule": "v"}], "sector_specific_entities": [{"entity_type": "Line", "key_parameters": ["gauge", "HFL"]}]})), ("doc1", "Metro", 2, json.dumps({"classes": [{"name": "Track"}], "sector_specific_entities": [{"entity_type": "Line", "key_parameters": ["speed"]}]})), ("doc2", "Ports", 3, "no json")]
ONTO_ROWS = [("class", "Track", "Metro", "doc0", "new"), ("class", "Track", "Metro", "doc1", ""), ("dependency", "pile", "Metro", "doc0", "soil||v"), ("entity", "Line", "Metro", None, "speed")]


def _ontology(s, d):
    classes, deps, types = graph.ontology_tables(inline(s, ONTO, "doc_id string, sector string, seq long, raw string"))
    none = F.lit(None).cast("string")
    return (
        classes.select(F.lit("class").alias("kind"), "name", "sector", "doc_id", F.col("description").alias("said"))
        .unionByName(deps.select(F.lit("dependency").alias("kind"), F.col("parameter").alias("name"), "sector", "doc_id", F.concat_ws("|", "requires", "reason", "validation_rule").alias("said")))
        .unionByName(types.select(F.lit("entity").alias("kind"), "name", "sector", none.alias("doc_id"), F.array_join("key_parameters", ",").alias("said")))
    )


def _raw_rules(s):
    return graph.rule_rows(graph.useful_rules(inline(s, RAW_RULES, RULE_FIELDS)))


RAW_FACT = """raw AS (SELECT *, event_id, CASE WHEN event_id % 9 = 0 THEN 'doc99' ELSE doc_id END AS d, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN ' ' ELSE sector END AS s, CASE WHEN event_id % 4 = 0 THEN NULL ELSE unit END AS u,
 repeat(coalesce(context, ''), 40) AS c FROM (SELECT f.*, CAST(fact_id AS BIGINT) AS event_id FROM fact f))"""


def _raw_facts(s, d):
    """Facts as extraction writes them: some without sector or unit, some of unknown documents, some twice, contexts of any length."""
    f, k = A.facts(s, d), F.col("fact_id").cast("long")
    f = f.withColumns({
        "doc_id": F.when(k % 9 == 0, "doc99").otherwise(F.col("doc_id")), "sector": F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, " ").otherwise(F.col("sector")),
        "unit": F.when(k % 4 != 0, F.col("unit")), "context": F.expr("repeat(coalesce(context, ''), 40)"),
    })
    return f.unionByName(f.where(k % 10 == 3))


QUERIES = {
    # rules and parameters
    "unmatched_rules": _unmatched,
    "semantic_top1": lambda s, d: checks.vector_topk(*C._vectors(s, d), 1, 0.3),
    "semantic_second_pass": _second,
    "semantic_rows": _second_rows,
    "kg_gate_jaccard": lambda s, d: _gated(s, d).select("fact_id", "rule_id", "similarity", "overlap"),
    "word_jaccard": lambda s, d: A.rules(s).select(F.col("rule_id").alias("a"), F.col("attribute").alias("x")).join(A.rules(s).select(F.col("rule_id").alias("b"), F.col("attribute").alias("y"))).select("a", "b", E.word_jaccard(F.col("x"), F.col("y")).alias("overlap")),
    "merge_by_rule": lambda s, d: _merged(s, d).select("row_id", "doc_id", "rule_id", "fact_id", "classification"),
    "completeness": lambda s, d: matching.completeness(A.facts(s, d), A.documents(s), A.mandatory_parameters(s), A.applicable_sectors(s), _texts(s, d)),
    "title_case": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", E.title_case(F.concat_ws("/", "p_name", F.lower("p_brand"), F.lit("don't 3rd l/c"))).alias("said")),
    # violations and reports
    "violations": lambda s, d: _violations(s, d).select("violation_id", "stage", "kind", "doc_id", "severity", "attribute"),
    "violation_fact_links": lambda s, d: report.fact_links(A.facts(s, d), A.dependencies(s)),
    "compliance_fact_links": lambda s, d: C._rows(s, d).select("fact_id", "row_id", F.when(F.col("classification") == "Compliant", "PASS").otherwise("FAIL").alias("status")),
    "anomaly_summary": lambda s, d: report.engine_summary(_violations(s, d)).where("stage = 'anomaly'"),
    "consistency_summary": lambda s, d: report.engine_summary(_violations(s, d)).where("stage = 'consistency'"),
    "top_issues": lambda s, d: report.top_issues(_violations(s, d).where("stage = 'consistency'")).select("violation_id", "severity"),
    "exec_summary": lambda s, d: report.executive_summary(C._rows(s, d), _violations(s, d), checks.total_score(C._rows(s, d))),
    "report_order": lambda s, d: report.report_order(C._rows(s, d)).select("idx", "row_id", "classification", "severity"),
    "report_traceability": lambda s, d: report.traceability(C._rows(s, d), _violations(s, d)).select("section", "idx", "kind", "area", "page", "classification", "severity"),
    "report_appendix": lambda s, d: report.appendix(_violations(s, d)).select("idx", "type", "attribute", "severity"),
    "report_scores": lambda s, d: report.document_scores(C._rows(s, d), A.documents(s).unionByName(inline(s, [("doc9", "Airports")], "doc_id string, sector string"))),
    "report_compliance": lambda s, d: report.compliance_section(C._rows(s, d)),
    "legacy_report": lambda s, d: report.legacy_rows(inline(s, REPORTS, "report_id string, raw string")),
    "legacy_score": lambda s, d: report.legacy_score(inline(s, REPORTS, "report_id string, raw string")),
    # graph
    "triple_parse": _triples,
    "kg_nodes": lambda s, d: graph.kg_nodes(_triples(s, d)),
    "kg_edges": lambda s, d: graph.kg_edges(_triples(s, d)),
    "edge_strings": lambda s, d: graph.edge_strings(_triples(s, d)),
    "concept_batches": lambda s, d: graph.concept_batches(_triples(s, d)),
    "concept_labels": lambda s, d: _concepts(s, d).select("id", "item", F.array_join("concepts", ",").alias("concepts")),
    "concept_nodes": lambda s, d: graph.concept_nodes(_concepts(s, d)),
    "kg_stats": lambda s, d: graph.kg_stats(_triples(s, d), _concepts(s, d)),
    "ontology_upsert": _ontology,
    "rule_store": lambda s, d: graph.upsert(_raw_rules(s), ["standard_name", "clause", "attribute"], first=("rule_id",)).drop("sector"),
    "rule_sector_edges": lambda s, d: graph.sector_edges(checks.rule_sector_edges(_raw_rules(s), _raw_rules(s).select("rule_id", "sector")), "rule_id"),
    "document_upsert": lambda s, d: graph.document_rows(inline(s, META, META_FIELDS)),
    "fact_upsert": lambda s, d: graph.fact_rows(_raw_facts(s, d), A.documents(s)),
    "dependencies_clean": lambda s, d: checks.usable_dependencies(A.dependencies(s)),
    # pages and tables
    "page_routing": lambda s, d: pages.route_pages(A.pages(s, d)),
    "page_likely_tables": lambda s, d: pages.likely_tables(A.pages(s, d)).select("page_num"),
    "page_simple": lambda s, d: pages.simple_pages(A.pages(s, d)).select("page_num"),
    "page_range": lambda s, d: pages.pages_between(A.pages(s, d), fixed.REPORT_START, 50).select("page_num"),
    "page_least_text": lambda s, d: pages.texts_for(A.pages(s, d), fixed.LEAST_GRAPH_TEXT + 1).select("page_num", F.substring("text", 1, fixed.FACT_TEXT).alias("text")),
    "column_names": lambda s, d: inline(s, HEADERS, "id int, header array<string>").select("id", F.posexplode(tables.column_names(F.col("header"))).alias("place", "name")),
    "table_rows": lambda s, d: inline(s, CELLS, "id int, cells array<array<string>>").select("id", F.posexplode(tables.rows_of(F.col("cells"))).alias("row_index", "row")).select("id", "row_index", F.explode("row").alias("name", "cell")),
    "table_cascade": lambda s, d: _cascade(s, d),
    "json_repair": lambda s, d: inline(s, ANSWERS, "id int, raw string").select("id", hooks.repaired(F.col("raw")).alias("said")),
    "rule_seeds": lambda s, d: readers.seed_rules(inline(s, SEEDS, "raw string")),
    # samples for prompts and counts
    "useful_facts": lambda s, d: graph.useful_facts(A.facts(s, d)).select("fact_id"),
    "prompt_facts": lambda s, d: checks.measured(A.facts(s, d)).where(F.col("confidence") > fixed.PROMPT_CONFIDENCE).orderBy("source_page", "fact_id").limit(fixed.PROMPT_FACTS).select("fact_id", "source_page"),
    "ontology_facts": lambda s, d: checks.measured(A.facts(s, d)).orderBy(F.col("confidence").desc_nulls_first(), "fact_id").limit(fixed.ONTOLOGY_FACTS).select("fact_id", "confidence"),
    "fact_counts": lambda s, d: A.facts(s, d).groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if(F.col("fact_type") == "table_row").alias("table_rows")),
    "rule_counts": lambda s, d: A.documents(s).join(A.applicable_sectors(s), "sector").join(A.rule_sectors(s).withColumnRenamed("sector", "applies"), "applies").groupBy("doc_id").agg(F.countDistinct("rule_id").alias("rules")),
    "processing_stats": lambda s, d: _processing(s, d),
    "sector_standards": lambda s, d: inline(s, [(n, k, x) for n, k in fixed.SECTOR_KEYS for x in dict(fixed.SECTOR_STANDARDS)[k]], "sector string, short string, standard string"),
}


def _cascade(s, d):
    """Three extractions of each part's row: with blanks, with fewer blanks, with none."""
    p = s.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    row = lambda *cells: F.array(F.create_map(*[x for n, c in zip("abcd", cells) for x in (F.lit(n), c)]))
    one = F.when(k % 5 != 4, row(F.col("p_name"), F.when(k % 2 == 0, F.col("p_brand")), F.when(k % 3 == 0, F.col("p_type")).otherwise(" "), F.lit("1")))
    two = row(F.col("p_name"), F.col("p_brand"), F.when(k % 3 < 2, F.col("p_type")), F.lit("2"))
    two = F.when(k % 7 == 0, row(F.lit(""), F.lit(None), F.lit("nan"), F.lit("2"))).otherwise(two)
    three = row(F.lit(""), F.lit(""), F.lit(""), F.lit("3"))
    best = tables.cascade(one, two, three)
    return p.select("p_partkey", F.element_at(F.element_at(best, 1), "d").alias("stage"), tables.fill_rate(best).alias("fill_rate"))


def _processing(s, d):
    facts, rows = A.facts(s, d), checks.table_rows(s.read.parquet(f"{d}/part.parquet"))
    count = lambda df, stage: df.agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "n")
    raw, kept = count(rows, "table rows"), count(checks.filter_table_rows(rows), "table rows kept")
    return count(facts, "facts").unionByName(count(checks.normalise_facts(facts), "facts normalised")).unionByName(raw).unionByName(kept)


_SLASHED = "concat_ws('/', p_name, lower(p_brand), 'don''t 3rd l/c')"
_SCORED = "SELECT doc_id, count(*) AS total_checks, count(*) FILTER (classification = 'Compliant') AS compliant_count, CAST(sum(weight) AS BIGINT) AS total_weight, CAST(coalesce(sum(weight) FILTER (classification = 'Compliant'), 0) AS BIGINT) AS compliant_weight FROM rows_ GROUP BY doc_id"
_NC = "CASE WHEN classification = 'Non-Compliant' THEN 0 ELSE 1 END"
_SAY = "CASE WHEN coalesce({c}, '') = '' THEN '—' ELSE {c} END"


def say(c: str) -> str:
    return _SAY.format(c=c)


def lists(rows: list[tuple], names: str) -> str:
    """(id, list) rows as (id, place, element) ones."""
    flat = [(i, k, x) for i, xs in rows for k, x in enumerate(xs)]
    return f"SELECT * FROM {values(flat, names)}"


ORACLES = {
    "unmatched_rules": f"{MATCH}, {UNMATCHED} SELECT * FROM unmatched",
    "semantic_top1": C._TOPK.format(uv=C.UNITV, least=0.3, k=1),
    "semantic_second_pass": f"{MATCH}, {UNMATCHED}, {SECOND} SELECT * FROM second",
    "semantic_rows": f"{MATCH}, {UNMATCHED}, {SECOND}, sp AS (SELECT f.fact_id, r.rule_id, f.doc_id, f.sector, f.attribute, f.unit, f.value, f.source_page, {OF_RULE} FROM second s JOIN fact f ON f.fact_id = s.fact_id JOIN rule r ON r.rule_id = s.rule_id) {checked('sp', 'vector')}",
    "kg_gate_jaccard": f"{MATCH}, {GATE} SELECT fact_id, rule_id, similarity, overlap FROM gated",
    "word_jaccard": f"WITH {C.RULE}, w AS (SELECT rule_id, list_distinct(string_split(lower(attribute), ' ')) AS ws FROM rule) SELECT a.rule_id AS a, b.rule_id AS b, len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) AS overlap FROM w a, w b",
    "merge_by_rule": f"{MATCH}, {UNMATCHED}, {SECOND}, {GATE}, sp AS (SELECT f.fact_id, r.rule_id, f.doc_id, f.sector, f.attribute, f.unit, f.value, f.source_page, {OF_RULE} FROM second s JOIN fact f ON f.fact_id = s.fact_id JOIN rule r ON r.rule_id = s.rule_id), "
    f"have AS ({checked('pairs')} UNION ALL {checked('sp', 'vector')}), more AS ({checked('gated', 'graph')}), new AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY fact_id) AS k FROM more m WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.doc_id = m.doc_id AND h.rule_id = m.rule_id)) "
    "SELECT row_id, doc_id, rule_id, fact_id, classification FROM have UNION ALL SELECT row_id, doc_id, rule_id, fact_id, classification FROM new WHERE k = 1",
    "completeness": f"{MATCH}, {ONTOLOGY}, {MISSING}",
    "title_case": f"SELECT p_partkey, {title(_SLASHED)} AS said FROM part",
    "violations": f"WITH {VIOLATIONS} SELECT * FROM viol",
    "violation_fact_links": f"WITH {C.FACT} {LINKS}",
    "compliance_fact_links": f"WITH {C.ROWS} SELECT fact_id, row_id, CASE WHEN classification = 'Compliant' THEN 'PASS' ELSE 'FAIL' END AS status FROM rows_",
    "anomaly_summary": _counts("anomaly")[1],
    "consistency_summary": _counts("consistency")[1],
    "top_issues": f"WITH {VIOLATIONS} SELECT violation_id, severity FROM viol WHERE stage = 'consistency' ORDER BY {RANK}, violation_id LIMIT 5",
    "exec_summary": f"WITH {C.ROWS}, {VIOLATIONS}, s AS (SELECT count(*) AS total, coalesce(round(coalesce(sum(weight) FILTER (classification = 'Compliant'), 0) * 100.0::DOUBLE / sum(weight), 1), 0) AS score FROM rows_) SELECT (SELECT count(*) FROM rows_ WHERE classification = 'Non-Compliant' AND severity = 'CRITICAL') AS critical_non_compliant, "
    "(SELECT count(*) FROM rows_ WHERE classification = 'Non-Compliant') AS non_compliant, (SELECT count(*) FROM viol WHERE stage = 'consistency' AND severity IN ('HIGH', 'CRITICAL')) AS high_issues, (SELECT count(*) FROM viol WHERE stage = 'anomaly' AND severity IN ('HIGH', 'CRITICAL')) AS high_flags, "
    f"(SELECT CASE {C.VERDICT} " + " ".join(f"WHEN '{v}' THEN {q(x)}" for v, x in fixed.HEALTH[:-1]) + f" ELSE {q(fixed.HEALTH[-1][1])} END FROM s) AS health",
    "report_order": f"WITH {C.ROWS} SELECT row_number() OVER (ORDER BY {_NC}, {RANK}, row_id) AS idx, row_id, classification, severity FROM rows_",
    "report_traceability": f"WITH {C.ROWS}, {VIOLATIONS} SELECT 'compliance' AS section, row_number() OVER (ORDER BY {_NC}, CASE WHEN classification = 'Non-Compliant' THEN {RANK} ELSE 0 END, row_id) AS idx, {say('standard')} AS kind, {say('check_area')} AS area, {PAGE_SQL} AS page, classification, severity FROM rows_ "
    f"UNION ALL SELECT stage, row_number() OVER (PARTITION BY stage ORDER BY {RANK}, violation_id), kind, {say('attribute')}, '—', NULL, severity FROM viol WHERE stage = 'consistency' OR severity IN ('CRITICAL', 'HIGH')",
    "report_appendix": f"WITH {VIOLATIONS} SELECT row_number() OVER (ORDER BY {RANK}, violation_id) AS idx, {LABEL} AS type, {say('attribute')} AS attribute, severity FROM viol WHERE stage = 'anomaly'",
    "report_scores": f"WITH {C.ROWS}, d AS (SELECT * FROM {values([*A.DOCUMENTS, ('doc9', 'Airports')], 'doc_id, sector')}), s AS ({_SCORED}), t AS (SELECT d.doc_id, d.sector, coalesce(total_checks, 0) AS total_checks, coalesce(compliant_count, 0) AS compliant_count, coalesce(total_weight, 0) AS total_weight, coalesce(compliant_weight, 0) AS compliant_weight FROM d LEFT JOIN s USING (doc_id)), "
    f"u AS (SELECT *, total_checks - compliant_count AS non_compliant_count, total_weight - compliant_weight AS non_compliant_weight, coalesce(round(compliant_weight * 100.0::DOUBLE / nullif(total_weight, 0), 1), 0) AS weighted_score FROM t) SELECT *, {C.VERDICT.replace('total = 0', 'total_checks = 0').replace('score >=', 'weighted_score >=')} AS verdict FROM u",
    "report_compliance": f"WITH {C.ROWS}, s AS (SELECT 'severity' AS section, severity AS name, count(*) AS total, count(*) FILTER (classification = 'Compliant') AS compliant, floor(count(*) FILTER (classification = 'Compliant') * 100.0::DOUBLE / count(*) + 0.5) AS percent, {RANK} AS o FROM rows_ WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') GROUP BY severity "
    "UNION ALL SELECT 'category', n, count(*), count(*) FILTER (classification = 'Compliant'), round(count(*) FILTER (classification = 'Compliant') * 100.0::DOUBLE / count(*), 1), round(count(*) FILTER (classification = 'Compliant') * 100.0::DOUBLE / count(*), 1) FROM (SELECT *, CASE WHEN category = '' THEN 'Uncategorised' ELSE category END AS n FROM rows_) GROUP BY n) "
    "SELECT section, name, total, compliant, total - compliant AS non_compliant, percent, CAST(row_number() OVER (PARTITION BY section ORDER BY o, name) AS INTEGER) AS place FROM s",
    "legacy_report": f"SELECT * FROM {values(LEGACY, 'report_id, ' + ', '.join(report._COMMON))}",
    "legacy_score": f"SELECT report_id, CAST(total_checks AS BIGINT) AS total_checks, CAST(compliant_count AS BIGINT) AS compliant_count, CAST(non_compliant_count AS BIGINT) AS non_compliant_count, weighted_score, verdict FROM {values(LEGACY_SCORES, 'report_id, total_checks, compliant_count, non_compliant_count, weighted_score, verdict')}",
    "triple_parse": f"WITH {TRIPLE} SELECT * FROM triple",
    "kg_nodes": f"WITH {TRIPLE}, {NODES} SELECT * FROM nodes",
    "kg_edges": f"WITH {TRIPLE}, {EDGES} SELECT * FROM edges",
    "edge_strings": f"WITH {TRIPLE} SELECT doc_id, seq, concat_ws(' ', head, relation, tail) AS triple_string FROM triple",
    "concept_batches": f"WITH {TRIPLE}, i AS (SELECT doc_id, 0 AS kind, lower(head) AS item, seq * 2 AS o FROM triple UNION ALL SELECT doc_id, 0, lower(tail), seq * 2 + 1 FROM triple UNION ALL SELECT doc_id, 1, lower(relation), seq FROM triple), g AS (SELECT doc_id, kind, item, min(o) AS o FROM i GROUP BY ALL), "
    f"k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY o, item) AS n FROM g), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, n) AS place FROM k WHERE n <= CASE kind WHEN 0 THEN {fixed.CONCEPT_ENTITIES} ELSE {fixed.CONCEPT_RELATIONS} END) SELECT doc_id, item, CAST((place - 1) // {fixed.CONCEPT_BATCH} AS INTEGER) AS batch FROM c",
    "concept_labels": f"WITH {CONCEPT} SELECT id, item, array_to_string(concepts, ',') AS concepts FROM labels",
    "concept_nodes": f"WITH {CONCEPT} SELECT * FROM concept",
    "kg_stats": f"WITH {TRIPLE}, {NODES}, {EDGES}, {CONCEPT}, d AS (SELECT doc_id FROM nodes UNION SELECT doc_id FROM edges UNION SELECT doc_id FROM concept) SELECT doc_id, (SELECT count(*) FROM nodes n WHERE n.doc_id = d.doc_id) AS entities, (SELECT count(*) FROM edges n WHERE n.doc_id = d.doc_id) AS triples, (SELECT count(*) FROM concept n WHERE n.doc_id = d.doc_id) AS concepts FROM d",
    "ontology_upsert": f"SELECT * FROM {values(ONTO_ROWS, 'kind, name, sector, doc_id, said')}",
    "rule_store": f"SELECT * FROM {values(STORED_RULES, 'rule_id, standard_name, clause, attribute, rule_text, operator, threshold, unit, condition, severity')}",
    "rule_sector_edges": f"SELECT * FROM {values(RULE_EDGES, 'rule_id, sector')}",
    "document_upsert": f"SELECT doc_id, filename, doc_type, total_pages, sector, CAST(sector_confidence AS DOUBLE) AS sector_confidence, is_scanned, page_range, source_path FROM {values(META_ROWS, 'doc_id, filename, doc_type, total_pages, sector, sector_confidence, is_scanned, page_range, source_path')}",
    "fact_upsert": f"WITH {C.FACT}, {DOCS}, {RAW_FACT}, x AS (SELECT raw.d AS doc_id, coalesce(fact_type, 'parameter') AS fact_type, subject, attribute, value, coalesce(u, '') AS unit, substr(c, 1, {fixed.CONTEXT}) AS context, coalesce(confidence, 0.5) AS confidence, coalesce(source_page, 0) AS source_page, coalesce(nullif(trim(s), ''), docs.sector) AS sector FROM raw JOIN docs ON docs.doc_id = raw.d), "
    f"y AS (SELECT *, {key_of('f_', 'doc_id', 'fact_type', 'subject', 'attribute', 'value', 'unit', 'context', 'CAST(source_page AS VARCHAR)')} AS fact_id FROM x) SELECT * FROM (SELECT * FROM y QUALIFY count(*) OVER (PARTITION BY fact_id) >= 1 AND row_number() OVER (PARTITION BY fact_id ORDER BY confidence DESC) = 1)",
    "dependencies_clean": f"SELECT sector, trim(coalesce(parameter, '')) AS parameter, trim(coalesce(requires, '')) AS requires, trim(coalesce(reason, '')) AS reason, trim(coalesce(rule, '')) AS rule FROM ({A.DEPENDENCY_SQL}) WHERE length(trim(coalesce(parameter, ''))) >= 2 AND length(trim(coalesce(requires, ''))) >= 2",
    "page_routing": f"WITH {C.CLASSES} SELECT c.page_num, category, category IN ('TEXT', 'MIXED') AND n >= 80 AND regexp_matches(t, '[0-9]') AND len(lines) >= 3 AS reads_facts, category IN ('TABLE', 'MIXED') AS reads_tables FROM classes c JOIN pg USING (page_num)",
    "page_likely_tables": f"WITH {C.PAGE} SELECT page_num FROM pg WHERE regexp_matches(t, {q(fixed.TABLE_WORDS)}) OR line_count > 10 OR rects > 6",
    "page_simple": f"WITH {C.PAGE} SELECT page_num FROM pg WHERE t = '' OR (n <= 600 AND len(regexp_extract_all(t, {q(fixed.MEASURES)})) < 3)",
    "page_range": f"WITH {C.PAGE} SELECT page_num FROM pg WHERE page_num >= 7 AND page_num < 57",
    "page_least_text": f"WITH {C.PAGE} SELECT page_num, substr(text, 1, {fixed.FACT_TEXT}) AS text FROM pg JOIN documents ON doc_id = page_num WHERE n > {fixed.LEAST_GRAPH_TEXT}",
    "column_names": lists(NAMES, "id, place, name"),
    "table_rows": f"SELECT * FROM {values(CELL_ROWS, 'id, row_index, name, cell')}",
    "table_cascade": "WITH p AS (SELECT p_partkey, p_partkey AS k, CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE (2 + CAST(p_partkey % 2 = 0 AS INTEGER) + CAST(p_partkey % 3 = 0 AS INTEGER)) / 4 END AS one, CASE WHEN p_partkey % 7 = 0 THEN 0.5 WHEN p_partkey % 3 < 2 THEN 1 ELSE 0.75 END AS two FROM part) SELECT p_partkey, CASE WHEN one >= 0.75 THEN '1' WHEN two >= 0.75 THEN '2' ELSE '3' END AS stage, CAST(CASE WHEN one >= 0.75 THEN one WHEN two >= 0.75 THEN two ELSE 0.25 END AS DOUBLE) AS fill_rate FROM p",
    "json_repair": f"SELECT * FROM {values(REPAIRED, 'id, said')}",
    "rule_seeds": f"SELECT * FROM {values(SEED_ROWS, 'standard_name, sector, clause, rule_text, attribute, operator, threshold, unit, condition, severity')}",
    "useful_facts": f"WITH {C.FACT} SELECT fact_id FROM fact WHERE subject <> '' AND trim(value) <> ''",
    "prompt_facts": f"WITH {C.FACT} SELECT fact_id, source_page FROM meas WHERE confidence > 0.6 ORDER BY source_page, fact_id LIMIT 80",
    "ontology_facts": f"WITH {C.FACT} SELECT fact_id, confidence FROM meas ORDER BY confidence DESC NULLS FIRST, fact_id LIMIT 60",
    "fact_counts": f"WITH {C.FACT} SELECT doc_id, count(*) AS facts, count(*) FILTER (fact_type = 'table_row') AS table_rows FROM fact GROUP BY 1",
    "rule_counts": f"WITH {C.RULE}, {DOCS} SELECT doc_id, count(DISTINCT rule_id) AS rules FROM docs JOIN applicable a USING (sector) JOIN rule_sector s ON s.sector = a.applies GROUP BY 1",
    "processing_stats": f"WITH {C.FACT}, {C.ROWMAP} SELECT 'facts' AS stage, count(*) AS n FROM fact UNION ALL SELECT 'facts normalised', count(*) FROM fact UNION ALL SELECT 'table rows', count(*) FROM rowsf UNION ALL SELECT 'table rows kept', count(*) FROM rowsf WHERE NOT h AND full_ > 0 AND (4 - full_) / 4 <= 0.8",
    "sector_standards": "SELECT * FROM " + values([(n, k, x) for n, k in fixed.SECTOR_KEYS for x in dict(fixed.SECTOR_STANDARDS)[k]], "sector, short, standard"),
}
