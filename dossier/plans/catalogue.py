"""Named queries over the driver tables, with their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from dossier import fixed
from dossier.functions import expr as E
from dossier.operators import checks, graph, hooks, pages
from dossier.sources import adapters as A

# ---- the same semantics in DuckDB's words


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chain(c: str, table, value: int = 1, otherwise: str = "NULL", show=q) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {q(r[0])}) THEN {show(r[value])}" for r in table) + f" ELSE {otherwise} END"


def num(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {q(E.NUMBER)}) THEN TRY_CAST({c} AS DOUBLE) END"


def loose(c: str) -> str:
    return num(f"regexp_replace(coalesce({c}, ''), '[^0-9.\\-]', '', 'g')")


def strict(c: str) -> str:
    found = f"list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '-?[0-9]+(?:\\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE)))"
    return f"CASE WHEN len({found}) = 1 THEN {found}[1] END"


def hits(c: str, patterns) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({c}, {q(p)}) AS INTEGER)" for p in patterns) + ")"


FACT = f"fact AS ({A.FACT_SQL.format(events='events')}), meas AS (SELECT * FROM fact WHERE fact_type <> 'table_row')"
RULE = f"rule AS ({A.RULE_SQL}), rule_sector AS ({A.RULE_SECTOR_SQL}), applicable AS ({A.APPLICABLE_SQL})"
UNIT = "regexp_replace(coalesce(unit, ''), '^\\s+|\\s+$', '', 'g')"
CANON_UNIT = chain(UNIT, fixed.UNIT_SPELLINGS, otherwise=UNIT)
WEIGHT = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in fixed.SEVERITY_WEIGHTS) + f" ELSE {fixed.DEFAULT_WEIGHT} END"
CANON_ATTR = chain("lower(trim(attribute))", [(f"^(?:{p})", v) for p, v in fixed.ATTRIBUTE_NAMES], otherwise="lower(trim(attribute))")

PAIRS = f"""{FACT}, {RULE},
pairs AS (SELECT f.fact_id, r.rule_id, s.sector AS applies, f.doc_id, f.sector, f.attribute, f.unit, r.attribute AS rule_attribute, r.standard_name, r.clause, r.severity, f.value, f.source_page, r.operator, r.threshold, r.unit AS rule_unit
 FROM meas f JOIN applicable a ON a.sector = f.sector JOIN rule_sector s ON s.sector = a.applies JOIN rule r ON r.rule_id = s.rule_id
 WHERE (r.cond IS NULL OR r.cond = '' OR contains(lower(f.context), lower(r.cond))) AND (contains(lower(f.attribute), lower(r.attribute)) OR contains(lower(r.attribute), lower(f.attribute))))"""
COMPARED = f"""CASE WHEN fv IS NOT NULL AND tv IS NOT NULL THEN CASE operator WHEN '>=' THEN fv >= tv WHEN '<=' THEN fv <= tv WHEN '>' THEN fv > tv WHEN '<' THEN fv < tv
 WHEN '==' THEN abs(fv - tv) < 1e-9 WHEN 'in_range' THEN CASE WHEN len(ps) >= 2 THEN fv >= CAST(ps[1] AS DOUBLE) AND fv <= CAST(ps[-1] AS DOUBLE) END END
 ELSE CASE operator WHEN '==' THEN CASE WHEN NOT regexp_matches(threshold, '[0-9]') AND (lv = lt OR contains(lv, lt) OR contains(lt, lv)) THEN true END
 WHEN 'must_be' THEN contains(lv, lt) WHEN 'must_not_be' THEN NOT contains(lv, lt) END END"""


def compared(source: str) -> str:
    return f"SELECT *, {COMPARED} AS ok FROM (SELECT *, {strict('value')} AS fv, {strict('threshold')} AS tv, regexp_extract_all(threshold, '[0-9.]+') AS ps, lower(trim(value)) AS lv, lower(trim(threshold)) AS lt FROM {source})"


def said(unit: str) -> str:
    u = f"CASE WHEN {unit} <> '' THEN concat(' ', {unit}) ELSE '' END"
    return f"""CASE operator WHEN '>=' THEN concat('at least ', threshold, {u}) WHEN '<=' THEN concat('no more than ', threshold, {u}) WHEN '>' THEN concat('greater than ', threshold, {u}) WHEN '<' THEN concat('less than ', threshold, {u})
 WHEN '==' THEN concat('exactly ', threshold, {u}) WHEN 'in_range' THEN concat('within range ', threshold, {u}) WHEN 'must_be' THEN concat('must be \'\'', threshold, '\'\'') WHEN 'must_not_be' THEN concat('must not be \'\'', threshold, '\'\'')
 WHEN 'requires' THEN concat('requires \'\'', threshold, '\'\'') WHEN 'every' THEN concat('every ', threshold, {u}) WHEN 'before' THEN concat('before ', threshold) WHEN 'after' THEN concat('after ', threshold) ELSE concat(operator, ' ', threshold, {u}) END""".replace("\\'", "'")


def title(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '\\pL+|[^\\pL]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"


def filled(sentence: str, **columns: str) -> str:
    parts = re.split(r"{(\w+)}", sentence)
    return "concat(" + ", ".join(f"coalesce({columns[x]}, '')" if k % 2 else q(x) for k, x in enumerate(parts) if x) + ")"


def key_of(prefix: str, *columns: str) -> str:
    return f"concat('{prefix}', substr(sha256(concat_ws('|', '{prefix}', {', '.join(columns)})), 1, 16))"


def checked(source: str, how: str = "rule") -> str:
    """Rows of checked pairs from a table like pairs."""
    names = {"attribute": "attribute", "dpr_value": "dpr_value", "rule_expected": "rule_expected", "std": "standard_name", "clause": "clause"}
    return f"""SELECT {key_of('c_', q(how), 'fact_id', 'rule_id', "coalesce(applies, '')")} AS row_id, fact_id, rule_id, applies, doc_id, sector, {title('rule_attribute')} AS check_area, standard_name AS category,
 trim(concat(standard_name, ' ', clause)) AS standard, severity, CASE WHEN ok THEN 'Compliant' ELSE 'Non-Compliant' END AS classification, ok IS NULL AS needs_review, {WEIGHT} AS weight, source_page, dpr_value, rule_expected,
 CASE WHEN ok THEN {filled(fixed.MEETS, **names)} WHEN NOT ok THEN {filled(fixed.FAILS, **names)} ELSE {filled(fixed.UNDECIDED, **names)} END AS reason
 FROM (SELECT * REPLACE (CASE WHEN coalesce(severity, '') = '' THEN 'HIGH' ELSE severity END AS severity), trim(concat(value, ' ', unit)) AS dpr_value, {said('rule_unit')} AS rule_expected FROM ({compared(source)}))"""


ROWS = f"{PAIRS}, rows_ AS ({checked('pairs')})"
VERDICT = "CASE WHEN total = 0 THEN 'NO_CHECKS_RUN' " + " ".join(f"WHEN score >= {b} THEN '{v}'" for b, v in fixed.VERDICTS) + " END"
CLEAN = """kept AS (SELECT * FROM fact WHERE NOT coalesce(confidence < 0.45 AND fact_type <> 'table_row', false)),
clean AS (SELECT * EXCLUDE (k) FROM (SELECT *, CASE WHEN fact_type <> 'table_row' THEN row_number() OVER (PARTITION BY coalesce(fact_type <> 'table_row', false), doc_id, subject, attribute, value ORDER BY confidence DESC NULLS LAST, fact_id) ELSE 1 END AS k FROM kept) WHERE k = 1)"""
FLAG_SQL = {
    "statistical_outlier": f"""u AS (SELECT fact_id, doc_id, sector, lower(trim(attribute)) AS attribute, {loose('value')} AS n FROM meas),
 s AS (SELECT doc_id, sector, attribute, count(*) AS k, avg(n) AS mean, stddev_samp(n) AS sd FROM u WHERE n IS NOT NULL GROUP BY ALL),
 o AS (SELECT u.*, abs(n - mean) / sd AS z, mean, sd FROM u JOIN s USING (doc_id, sector, attribute) WHERE n IS NOT NULL AND k >= 4 AND sd > 1e-12 * greatest(abs(mean), 1))
 SELECT fact_id, doc_id, sector, attribute, n, round(z, 6) AS z, round(mean - 2 * sd, 2) AS expected_low, round(mean + 2 * sd, 2) AS expected_high, CASE WHEN z > 4.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM o WHERE z > 3""",
    "oom_error": "u AS (SELECT fact_id, doc_id, lower(attribute) AS attribute, " + loose("value") + " AS n FROM meas), b AS (SELECT *, CASE " + " ".join(f"WHEN contains(attribute, {q(k)}) THEN {{'low': CAST({a} AS DOUBLE), 'high': CAST({z} AS DOUBLE)}}" for k, a, z, _ in fixed.KNOWN_RANGES)
    + " END AS b FROM u WHERE n <> 0 AND NOT (" + " OR ".join(f"contains(attribute, {q(s)})" for s in fixed.SIGNED_ATTRIBUTES) + ")) SELECT fact_id, doc_id, attribute, n, b.low AS low, b.high AS high, 'HIGH' AS severity FROM b WHERE n < b.low / 10 OR n > b.high * 10",
    "duplicate_values": """c AS (SELECT doc_id, lower(trim(attribute)) AS attribute, trim(value) AS value, count(*) AS k FROM meas GROUP BY ALL)
 SELECT doc_id, attribute, CAST(sum(k) AS BIGINT) AS n, max(k) AS modal_count, max({'k': k, 'value': value}).value AS flagged_value, 'MEDIUM' AS severity FROM c WHERE attribute <> '' GROUP BY doc_id, attribute HAVING sum(k) >= 4 AND max(k) / sum(k) >= 0.85""",
    "unit_mismatch": "g AS (SELECT doc_id, lower(trim(attribute)) AS attribute, list_sort(list(DISTINCT replace(lower(trim(unit)), ' ', ''))) AS units FROM meas WHERE unit <> '' GROUP BY ALL), m AS (SELECT *, CASE "
    + " ".join(f"WHEN len(list_intersect(units, [{', '.join(map(q, f))}])) >= 2 THEN array_to_string(list_sort(list_intersect(units, [{', '.join(map(q, f))}])), ',')" for f in fixed.UNIT_FAMILIES) + " END AS mixed FROM g) SELECT doc_id, attribute, mixed, 'MEDIUM' AS severity FROM m WHERE mixed IS NOT NULL",
}
MISMATCH = f"""u AS (SELECT doc_id, lower(trim(subject)) AS subject, {CANON_ATTR} AS attribute, {loose('value')} AS n, source_page FROM meas),
 g AS (SELECT doc_id, subject, attribute, count(*) AS n_facts, count(DISTINCT source_page) AS n_pages, min(n) AS lo, max(n) AS hi FROM u WHERE n IS NOT NULL AND subject NOT IN ({', '.join(map(q, fixed.GENERIC_SUBJECTS))}) GROUP BY ALL)
 SELECT *, (hi - lo) / hi AS spread, CASE WHEN (hi - lo) / hi > 0.3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM g WHERE n_facts >= 2 AND n_pages >= 2 AND hi <> 0 AND (hi - lo) / hi > 0.1"""
MISSING = f"""dep AS (SELECT sector, trim(coalesce(parameter, '')) AS parameter, trim(coalesce(requires, '')) AS requires, trim(coalesce(reason, '')) AS reason, trim(coalesce(rule, '')) AS rule FROM ({A.DEPENDENCY_SQL}) WHERE length(trim(coalesce(parameter, ''))) >= 2 AND length(trim(coalesce(requires, ''))) >= 2),
 nm AS (SELECT DISTINCT doc_id, sector, lower(attribute) AS name FROM fact UNION SELECT DISTINCT doc_id, sector, lower(subject) FROM fact),
 m AS (SELECT doc_id, sector, parameter, requires, reason, rule, bool_or(contains(name, lower(parameter))) AS p, bool_or(contains(name, lower(requires))) AS r FROM nm JOIN dep USING (sector) GROUP BY ALL)
 SELECT doc_id, sector, parameter, requires, 'HIGH' AS severity, {filled(fixed.PREREQUISITE, parameter='parameter', requires='requires')} AS description, {filled(fixed.EVIDENCE, reason='reason', rule='rule')} AS evidence FROM m WHERE p AND NOT r"""
UNITV = "uv AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / CASE WHEN nrm = 0 THEN 1 ELSE nrm END) AS u FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm FROM embeddings))"
ROWMAP = """blank AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE 'nan' END AS no FROM part), cells AS (SELECT p_partkey AS row_index, p_partkey % 13 = 0 AS h, [CASE WHEN p_partkey % 10 >= 9 THEN no ELSE p_name END, CASE WHEN p_partkey % 10 >= 8 THEN no ELSE p_brand END,
 CASE WHEN p_partkey % 10 >= 8 THEN no ELSE p_type END, CASE WHEN p_partkey % 10 >= 7 THEN no ELSE CAST(p_size AS VARCHAR) END] AS v FROM blank),
 rowsf AS (SELECT row_index, h, len(list_filter(v, lambda x: trim(x) <> '')) AS filled_, len(list_filter(v, lambda x: trim(x) NOT IN (""" + ", ".join(map(q, fixed.NULL_TEXTS)) + """))) AS full_ FROM cells)"""
PAGE = """pg AS (SELECT doc_id AS page_num, coalesce(text, '') AS t, doc_id % 60 AS rects, doc_id % 4 AS images, doc_id % 7 = 0 AS grid, doc_id % 13 AS line_count, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS n,
 list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents)"""
CLASSES = f"""{PAGE}, sc AS (SELECT *, CASE WHEN len(lines) = 0 THEN 0 ELSE len(list_filter(lines, lambda x: regexp_matches(x, {q(fixed.TOC_LINE)}))) / len(lines) END AS toc,
 least(1.0::DOUBLE, (CASE WHEN rects > 50 THEN 0.5 WHEN rects > 20 THEN 0.35 WHEN rects > 6 THEN 0.2 ELSE 0.0 END)::DOUBLE + (CASE WHEN grid THEN 0.3 ELSE 0.0 END)::DOUBLE + least(0.3::DOUBLE, {hits('t', fixed.TABLE_PATTERNS)} * 0.08::DOUBLE)) AS table_score,
 least(1.0::DOUBLE, least(0.5::DOUBLE, images * 0.2::DOUBLE) + (CASE WHEN n < 100 AND images > 0 THEN 0.4 ELSE 0.0 END)::DOUBLE + least(0.2::DOUBLE, {hits('t', fixed.IMAGE_PATTERNS)} * 0.1::DOUBLE)) AS image_score,
 {hits('t', fixed.ENGINEERING_PATTERNS)} / 6 AS e, {hits('t', fixed.HEADER_PATTERNS)} AS h, {hits('t', fixed.ADMIN_PATTERNS)} AS a FROM pg),
 classes AS (SELECT page_num, CASE WHEN n < 30 THEN 'SKIP' WHEN toc > 0.5 THEN 'SKIP' WHEN h > 0 AND n < 200 THEN 'SKIP' WHEN a >= 2 AND n < 500 THEN 'SKIP' WHEN image_score > 0.6 AND n < 150 THEN 'IMAGE'
 WHEN table_score > 0.6 AND e < 0.2 THEN 'TABLE' WHEN table_score > 0.3 AND (e > 0.2 OR n > 300) THEN 'MIXED' ELSE 'TEXT' END AS category, round(table_score, 6) AS table_score, round(image_score, 6) AS image_score FROM sc)"""


# ---- the queries


def _pairs(s, d):
    return checks.fact_rule_pairs(A.facts(s, d), A.rules(s), A.rule_sectors(s), A.applicable_sectors(s))


def _rows(s, d):
    return checks.compliance_rows(_pairs(s, d))


def _vectors(s, d):
    v = A.vectors(s, d)
    return v.where("vec_id >= 100"), v.where("vec_id < 100")


def _normal(s, d):
    return checks.normalise_facts(A.facts(s, d)).select("fact_id", "subject", "attribute", "value", "unit", "confidence")


def _values(s, d):
    return E.with_normalised_values(A.facts(s, d)).select("fact_id", "value", "unit")


def _truth(s, d):
    v = A.facts(s, d).select("value").distinct()
    return v.join(F.broadcast(A.rules(s).select("rule_id", "operator", "threshold"))).select("value", "rule_id", E.compare(F.col("value"), F.col("operator"), F.col("threshold")).alias("ok"))


def _override(s, d):
    """Labels stand for a model's verdicts: quality for the classification, toxic for the severity; some are invalid or empty."""
    r = _rows(s, d)
    lab = s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("string").alias("fact_id"), "quality", "toxic")
    said = F.when(F.col("fact_id").cast("int") % 7 == 0, "Unsure").when(F.col("quality") == 1, "Compliant").otherwise("Non-Compliant")
    v = r.select("row_id", "fact_id").join(lab, "fact_id").select("row_id", said.alias("classification"), F.when(F.col("toxic") == 1, "CRITICAL").otherwise("ODD").alias("severity"), F.when(F.col("quality") == 1, " checked ").otherwise(" ").alias("reason"))
    return hooks.with_verdicts(r, v).select("row_id", "classification", "severity", "weight", "reason")


def _table_ids(s, d):
    rows = checks.table_rows(s.read.parquet(f"{d}/part.parquet")).withColumns({"doc_id": F.lit("part"), "page": F.lit(3), "sector": F.lit("Metro")})
    return graph.table_row_facts(rows).select("fact_id", "row_index", "value")


QUERIES = {
    "unit_canonicalise": lambda s, d: A.facts(s, d).select("fact_id", E.canonical_unit(F.col("unit")).alias("unit")),
    "unit_normalise": _values,
    "fact_normalise": _normal,
    "extract_numeric_loose": lambda s, d: A.facts(s, d).select("fact_id", E.numeric_loose(F.col("value")).alias("n")),
    "extract_numeric_strict": lambda s, d: A.facts(s, d).select("fact_id", E.numeric_strict(F.col("value")).alias("n")),
    "attribute_canonical": lambda s, d: A.facts(s, d).select("fact_id", E.canonical_attribute(F.col("attribute")).alias("attribute")),
    "operator_describe": lambda s, d: A.rules(s).select("rule_id", E.describe_operator(F.col("operator"), F.col("threshold"), F.col("unit")).alias("said")),
    "filter_facts_reasons": lambda s, d: A.facts(s, d).groupBy(checks.rejection_reason().alias("reason")).agg(F.count("*").alias("n")),
    "table_row_filter": lambda s, d: checks.filter_table_rows(checks.table_rows(s.read.parquet(f"{d}/part.parquet"))).select("row_index"),
    "fill_rate": lambda s, d: checks.fill_rate(checks.table_rows(s.read.parquet(f"{d}/part.parquet"))).select("row_index", "fill_rate"),
    "low_confidence_filter": lambda s, d: checks.drop_low_confidence(A.facts(s, d)).select("fact_id", "confidence"),
    "dedup_keep_best": lambda s, d: checks.keep_best(checks.measured(A.facts(s, d)), ("doc_id", "subject", "attribute")).select("fact_id", "doc_id", "subject", "attribute", "confidence"),
    "duplicate_groups": lambda s, d: checks.duplicate_groups(A.facts(s, d)),
    "facts_clean": lambda s, d: checks.clean_facts(A.facts(s, d)).select("fact_id", "doc_id", "attribute", "value", "confidence"),
    "page_classify": lambda s, d: pages.classify_pages(A.pages(s, d)),
    "page_class_summary": lambda s, d: pages.classify_pages(A.pages(s, d)).groupBy("category").agg(F.count("*").alias("n")),
    "extractable_pages": lambda s, d: pages.extractable(A.pages(s, d)).select("page_num"),
    "chunk_text": lambda s, d: pages.chunk_pages(A.pages(s, d)),
    "numeric_mismatch": lambda s, d: checks.numeric_mismatch(A.facts(s, d)),
    "missing_dependency": lambda s, d: checks.missing_dependency(A.facts(s, d), A.dependencies(s)),
    "statistical_outlier": lambda s, d: checks.statistical_outlier(A.facts(s, d)),
    "oom_error": lambda s, d: checks.oom_error(A.facts(s, d)),
    "duplicate_values": lambda s, d: checks.duplicate_values(A.facts(s, d)),
    "unit_mismatch": lambda s, d: checks.unit_mismatch(A.facts(s, d)),
    "sector_hierarchy": lambda s, d: A.applicable_sectors(s),
    "fact_rule_pairs": lambda s, d: _pairs(s, d).select("fact_id", "rule_id", "applies"),
    "compare_truth_table": _truth,
    "compliance_rows": _rows,
    "vector_topk": lambda s, d: checks.vector_topk(*_vectors(s, d), 3),
    "verdict_override": _override,
    "score_total": lambda s, d: checks.total_score(_rows(s, d)),
    "score_by_severity": lambda s, d: checks.by_severity(_rows(s, d)),
    "score_by_category": lambda s, d: checks.by_category(_rows(s, d)),
    "rule_upsert": lambda s, d: checks.upsert_rules(A.rules(s)),
    "table_row_id": _table_ids,
}
_VALUE = f"v AS (SELECT *, regexp_replace(regexp_replace(value, '[,\\s]', '', 'g'), '(?i)approx\\.?|about|~|±[0-9]*', '', 'g') AS v, {CANON_UNIT} AS u FROM fact), x AS (SELECT *, {num('v')} AS x, {chain('u', fixed.UNIT_CONVERSIONS, 2, show=lambda f: f'{f}::DOUBLE')} AS m FROM v)"
_NEW = f"CASE WHEN x IS NULL THEN v ELSE printf('%g', CASE WHEN m IS NULL THEN x ELSE round(x * m, 6) END) END AS value, CASE WHEN x IS NULL THEN u ELSE coalesce({chain('u', fixed.UNIT_CONVERSIONS, 1)}, u) END AS unit"
_TOPK = "WITH {uv}, m AS (SELECT p.vec_id AS probe_id, i.vec_id AS item_id, round(list_sum(list_transform(range(1, len(i.u) + 1), lambda j: i.u[j] * p.u[j])), 9) AS score FROM uv i, uv p WHERE i.vec_id >= 100 AND p.vec_id < 100), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM m WHERE score >= {least}) SELECT * FROM r WHERE rank <= {k}"
ORACLES = {
    "unit_canonicalise": f"WITH {FACT} SELECT fact_id, {CANON_UNIT} AS unit FROM fact",
    "unit_normalise": f"WITH {FACT}, {_VALUE} SELECT fact_id, {_NEW} FROM x",
    "fact_normalise": f"WITH {FACT}, {_VALUE} SELECT fact_id, trim(subject) AS subject, lower(trim(attribute)) AS attribute, {_NEW}, greatest(0, least(1, confidence)) AS confidence FROM x",
    "extract_numeric_loose": f"WITH {FACT} SELECT fact_id, {loose('value')} AS n FROM fact",
    "extract_numeric_strict": f"WITH {FACT} SELECT fact_id, {strict('value')} AS n FROM fact",
    "attribute_canonical": f"WITH {FACT} SELECT fact_id, {CANON_ATTR} AS attribute FROM fact",
    "operator_describe": f"WITH {RULE} SELECT rule_id, {said('unit')} AS said FROM rule",
    "filter_facts_reasons": f"WITH {FACT} SELECT CASE WHEN trim(value) = '' THEN 'empty_value' WHEN length(trim(subject)) < 2 THEN 'short_subject' WHEN confidence < 0.45 THEN 'low_confidence' WHEN regexp_matches(trim(value), '^[.\\-:,\\s]+$') THEN 'punctuation' ELSE 'kept' END AS reason, count(*) AS n FROM fact GROUP BY 1",
    "table_row_filter": f"WITH {ROWMAP} SELECT row_index FROM rowsf WHERE NOT h AND full_ > 0 AND (4 - full_) / 4 <= 0.8",
    "fill_rate": f"WITH {ROWMAP} SELECT row_index, CASE WHEN h THEN 1.0 ELSE filled_ / 4 END::DOUBLE AS fill_rate FROM rowsf",
    "low_confidence_filter": f"WITH {FACT} SELECT fact_id, confidence FROM fact WHERE NOT coalesce(confidence < 0.45 AND fact_type <> 'table_row', false)",
    "dedup_keep_best": f"WITH {FACT} SELECT fact_id, doc_id, subject, attribute, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, subject, attribute ORDER BY confidence DESC NULLS LAST, fact_id) AS k FROM meas) WHERE k = 1",
    "duplicate_groups": f"WITH {FACT} SELECT doc_id, subject, attribute, value, count(*) AS n, arg_min(fact_id, {{'c': -confidence, 'f': fact_id}}) AS keep_id FROM meas GROUP BY ALL HAVING count(*) > 1",
    "facts_clean": f"WITH {FACT}, {CLEAN} SELECT fact_id, doc_id, attribute, value, confidence FROM clean",
    "page_classify": f"WITH {CLASSES} SELECT * FROM classes",
    "page_class_summary": f"WITH {CLASSES} SELECT category, count(*) AS n FROM classes GROUP BY 1",
    "chunk_text": """WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE text <> ''),
 w AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM d WHERE length(text) > 5000))),
 c AS (SELECT doc_id, i, x, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
 p AS (SELECT doc_id, list(x ORDER BY i) AS ws, list_concat([0::HUGEINT], list(upto ORDER BY i)) AS p, count(*) AS n FROM c GROUP BY doc_id),
 s AS (SELECT doc_id, 0 AS k, 0::BIGINT AS a, greatest(1, len(list_filter(p, lambda x: x <= 5000)) - 1) AS b FROM p
  UNION ALL SELECT doc_id, k + 1, a2, greatest(b + 1, len(list_filter(p, lambda x: x <= p[a2 + 1] + 5000)) - 1) FROM (SELECT s.doc_id, k, b, p, greatest(a, len(list_filter(p, lambda x: x < p[b + 1] - 150))) AS a2 FROM s JOIN p ON p.doc_id = s.doc_id WHERE b < n))
 SELECT doc_id AS page_num, 0 AS chunk, text FROM d WHERE length(text) <= 5000 UNION ALL SELECT s.doc_id, k, array_to_string(ws[a + 1:b], ' ') FROM s JOIN p ON p.doc_id = s.doc_id""",
    "extractable_pages": f"WITH {PAGE} SELECT page_num FROM pg WHERE n >= 80 AND regexp_matches(t, '[0-9]') AND len(lines) >= 3",
    "numeric_mismatch": f"WITH {FACT}, {MISMATCH}",
    "missing_dependency": f"WITH {FACT}, {MISSING}",
    **{k: f"WITH {FACT}, {v}" for k, v in FLAG_SQL.items()},
    "sector_hierarchy": A.APPLICABLE_SQL,
    "fact_rule_pairs": f"WITH {PAIRS} SELECT fact_id, rule_id, applies FROM pairs",
    "compare_truth_table": f"WITH {FACT}, {RULE}, vr AS (SELECT value, rule_id, operator, threshold FROM (SELECT DISTINCT value FROM fact), rule), c AS ({compared('vr')}) SELECT value, rule_id, ok FROM c",
    "compliance_rows": f"WITH {ROWS} SELECT * FROM rows_",
    "vector_topk": _TOPK.format(uv=UNITV, least=-2.0, k=3),
    "verdict_override": f"""WITH {ROWS}, l AS (SELECT CAST(doc_id AS VARCHAR) AS fact_id, CASE WHEN doc_id % 7 = 0 THEN 'Unsure' WHEN quality = 1 THEN 'Compliant' ELSE 'Non-Compliant' END AS c, CASE WHEN toxic = 1 THEN 'CRITICAL' ELSE 'ODD' END AS s, CASE WHEN quality = 1 THEN 'checked' ELSE '' END AS r FROM labels),
 j AS (SELECT row_id, CASE WHEN classification = 'Non-Compliant' AND c IN ('Compliant', 'Non-Compliant') THEN c ELSE classification END AS classification, CASE WHEN classification = 'Non-Compliant' AND s = 'CRITICAL' THEN s ELSE severity END AS severity, CASE WHEN classification = 'Non-Compliant' AND r <> '' THEN r ELSE reason END AS reason FROM rows_ LEFT JOIN l ON l.fact_id = rows_.fact_id)
 SELECT row_id, classification, severity, {WEIGHT} AS weight, reason FROM j""",
    "score_total": f"WITH {ROWS}, s AS (SELECT count(*) AS total, count(*) FILTER (classification = 'Compliant') AS compliant, CAST(coalesce(sum(weight), 0) AS BIGINT) AS total_weight, CAST(coalesce(sum(weight) FILTER (classification = 'Compliant'), 0) AS BIGINT) AS compliant_weight FROM rows_), t AS (SELECT *, total - compliant AS non_compliant, total_weight - compliant_weight AS non_compliant_weight, coalesce(round(compliant_weight * 100.0::DOUBLE / nullif(total_weight, 0), 1), 0) AS score FROM s) SELECT *, {VERDICT} AS verdict FROM t",
    "score_by_severity": f"WITH {ROWS} SELECT severity, count(*) AS total, count(*) FILTER (classification = 'Compliant') AS compliant, count(*) FILTER (classification <> 'Compliant') AS non_compliant, CAST(sum(weight) AS BIGINT) AS weight, CAST(coalesce(sum(weight) FILTER (classification = 'Compliant'), 0) AS BIGINT) AS compliant_weight FROM rows_ WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') GROUP BY severity",
    "score_by_category": f"WITH {ROWS} SELECT CASE WHEN category = '' THEN 'Uncategorised' ELSE category END AS category, count(*) AS total, count(*) FILTER (classification = 'Compliant') AS compliant, count(*) FILTER (classification <> 'Compliant') AS non_compliant, round(count(*) FILTER (classification = 'Compliant') * 100.0::DOUBLE / count(*), 1) AS category_score FROM rows_ GROUP BY 1",
    "rule_upsert": f"WITH {RULE} SELECT standard_name, clause, attribute, min_by(rule_id, seq) AS rule_id, max_by(operator, seq) AS operator, max_by(threshold, seq) AS threshold, max_by(severity, seq) AS severity FROM rule GROUP BY standard_name, clause, attribute",
    "table_row_id": f"""WITH b AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE 'nan' END AS no, p_partkey % 10 AS k, p_partkey % 13 = 0 AS h FROM part),
 c AS (SELECT p_partkey, concat('{{"p_brand": "', CASE WHEN h THEN 'p_brand' WHEN k >= 8 THEN no ELSE p_brand END, '", "p_name": "', CASE WHEN h THEN 'p_name' WHEN k >= 9 THEN no ELSE p_name END, '", "p_size": "', CASE WHEN h THEN 'p_size' WHEN k >= 7 THEN no ELSE CAST(p_size AS VARCHAR) END, '", "p_type": "', CASE WHEN h THEN 'p_type' WHEN k >= 8 THEN no ELSE p_type END, '"}}') AS value FROM b)
 SELECT concat('tr_', substr(md5(concat_ws('_', 'part', '3', CAST(p_partkey AS VARCHAR), value)), 1, 16)) AS fact_id, p_partkey AS row_index, value FROM c""",
}

from dossier.plans import extended  # noqa: E402

QUERIES |= extended.QUERIES
ORACLES |= extended.ORACLES
