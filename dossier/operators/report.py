"""Issues and flags as one table, their links to facts, and the tables of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import fixed
from dossier.functions import expr as E
from dossier.operators import checks

COLUMNS = ("violation_id", "stage", "kind", "doc_id", "severity", "attribute", "flagged_value", "expected_range", "description")


def _rows(found: DataFrame, stage: str, kind: str, key: list, attribute, value=None, expected=None, description=None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return found.select(E.key_of("v_", F.lit(kind), *key).alias("violation_id"), F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), "doc_id", "severity", text(attribute).alias("attribute"), text(value).alias("flagged_value"), text(expected).alias("expected_range"), text(description).alias("description"))


def issues(facts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """What the consistency checks find."""
    mismatch = _rows(checks.numeric_mismatch(facts), "consistency", "numeric_mismatch", ["doc_id", "subject", "attribute"], F.concat_ws(" → ", "subject", "attribute"))
    missing = _rows(checks.missing_dependency(facts, dependencies), "consistency", "missing_dependency", ["doc_id", "parameter", "requires"], F.col("parameter"), None, None, F.col("description"))
    return mismatch.unionByName(missing)


def flags(facts: DataFrame) -> DataFrame:
    """What the anomaly checks find."""
    a, text = F.col("attribute"), lambda c: F.col(c).cast("string")
    outlier = _rows(checks.statistical_outlier(facts), "anomaly", "statistical_outlier", ["fact_id"], a, text("n"), F.concat_ws(" – ", text("expected_low"), text("expected_high")))
    oom = _rows(checks.oom_error(facts), "anomaly", "oom_error", ["fact_id"], a, text("n"), F.concat_ws(" – ", text("low"), text("high")))
    same = _rows(checks.duplicate_values(facts), "anomaly", "duplicate_values", ["doc_id", "attribute"], a, F.col("flagged_value"))
    mixed = _rows(checks.unit_mismatch(facts), "anomaly", "unit_mismatch", ["doc_id", "attribute"], a, F.col("mixed"))
    return outlier.unionByName(oom).unionByName(same).unionByName(mixed)


def engine_summary(violations: DataFrame) -> DataFrame:
    """stage, by, name, n: counts by kind and by severity under a fixed list of names, zeros kept."""
    kinds = {"consistency": ("numeric_mismatch", "missing_dependency", "llm_flagged"), "anomaly": tuple(k for k, _ in fixed.ANOMALY_LABELS)}
    cells = [(s, "kind", k) for s, ks in kinds.items() for k in ks] + [(s, "severity", v) for s in kinds for v in fixed.SEVERITIES[:4]] + [(s, "total", "") for s in kinds]
    counted = violations.agg(*[F.count_if((F.col("stage") == s) & (F.lit(True) if by == "total" else F.col(by) == name)).alias(f"c{j}") for j, (s, by, name) in enumerate(cells)])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(by).alias("by"), F.lit(name).alias("name"), F.col(f"c{j}").alias("n")) for j, (s, by, name) in enumerate(cells)])))


def top_issues(violations: DataFrame, k: int = 5) -> DataFrame:
    """The k most severe, CRITICAL first, ties by id."""
    return violations.orderBy(E.severity_rank(F.col("severity")), "violation_id").limit(k)


def fact_links(facts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """violation_id, fact_id: every fact that an issue or flag is about. Facts meet groups by their key, so no group is gathered in a list."""
    v = lambda kind, *key: E.key_of("v_", F.lit(kind), *key).alias("violation_id")
    mismatch = checks._mismatch_facts(facts).join(checks.numeric_mismatch(facts).select("doc_id", "subject", "attribute"), ["doc_id", "subject", "attribute"]).select(v("numeric_mismatch", "doc_id", "subject", "attribute"), "fact_id")
    missing = checks.missing_dependency(facts, dependencies).select("doc_id", "parameter", "requires")
    low = F.lower("parameter")
    named = facts.select("fact_id", "doc_id", F.lower(F.coalesce("attribute", F.lit(""))).alias("a"), F.lower(F.coalesce("subject", F.lit(""))).alias("s"))
    without = named.join(missing, "doc_id").where(F.col("a").contains(low) | F.col("s").contains(low)).select(v("missing_dependency", "doc_id", "parameter", "requires"), "fact_id")
    single = [f.select(v(kind, "fact_id"), "fact_id") for kind, f in (("statistical_outlier", checks.statistical_outlier(facts)), ("oom_error", checks.oom_error(facts)))]
    keyed = checks.measured(facts).select("fact_id", "doc_id", F.lower(F.trim("attribute")).alias("attribute"), "unit")
    same = keyed.join(checks.duplicate_values(facts).select("doc_id", "attribute"), ["doc_id", "attribute"]).select(v("duplicate_values", "doc_id", "attribute"), "fact_id")
    mixed = keyed.where("unit <> ''").join(checks.unit_mismatch(facts).select("doc_id", "attribute"), ["doc_id", "attribute"]).select(v("unit_mismatch", "doc_id", "attribute"), "fact_id")
    out = mismatch.unionByName(without).unionByName(same).unionByName(mixed)
    for x in single:
        out = out.unionByName(x)
    return out


def enumerated(rows: DataFrame, ranks: list[Column], id_col: str, name: str = "idx") -> DataFrame:
    """Numbers from 1 in the order of ranks (few values), then of an id that ends in hexadecimal digits of a hash.

    The id's first digits deal each rank's rows out evenly; a small table of counts says where each part begins, so no task sorts a whole rank.
    """
    r = [f"_r{j}" for j in range(len(ranks))]
    part = F.substring(id_col, 3, 3)
    x = rows.withColumns({**dict(zip(r, ranks)), "_part": part})
    counts = x.groupBy(*r, "_part").agg(F.count("*").alias("_n"))  # 4,096 rows for each combination of ranks at most
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy(*r, "_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    at = x.join(before, [*r, "_part"]).withColumn(name, F.row_number().over(Window.partitionBy(*r, "_part").orderBy(id_col)) + F.coalesce("_before", F.lit(0)))
    return at.drop(*r, "_part", "_before")


def report_order(rows: DataFrame) -> DataFrame:
    """Checked rows, non-compliant ones first, then by severity; idx numbers them."""
    return enumerated(rows, [(F.col("classification") != "Non-Compliant").cast("int"), E.severity_rank(F.col("severity"))], "row_id")


def _page(c: str) -> Column:
    return F.when(F.coalesce(c, F.lit(0)) > 0, F.concat(F.lit("p."), F.col(c).cast("string"))).otherwise("—")


def _said(c: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "—").otherwise(F.col(c))


def traceability(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """section, idx and what the matrix shows: all checked rows (compliant ones in no order of severity), all issues, and flags that are high or critical."""
    nc = F.col("classification") == "Non-Compliant"
    checked = enumerated(rows, [(~nc).cast("int"), F.when(nc, E.severity_rank(F.col("severity"))).otherwise(0)], "row_id")
    checked = checked.select(F.lit("compliance").alias("section"), "idx", _said("standard").alias("kind"), _said("check_area").alias("area"), _said("dpr_value").alias("value"), _said("rule_expected").alias("expected"), _page("source_page").alias("page"), "classification", "severity", _said("reason").alias("said"))
    found = violations.where((F.col("stage") == "consistency") | F.col("severity").isin("CRITICAL", "HIGH"))
    found = enumerated(found, [F.col("stage"), E.severity_rank(F.col("severity"))], "violation_id")
    # numbers begin anew in each section
    least = found.groupBy("stage").agg((F.min("idx") - 1).alias("_least"))
    found = found.join(least, "stage").select(F.col("stage").alias("section"), (F.col("idx") - F.col("_least")).alias("idx"), "kind", _said("attribute").alias("area"), _said("flagged_value").alias("value"), _said("expected_range").alias("expected"), F.lit("—").alias("page"), F.lit(None).cast("string").alias("classification"), "severity", _said("description").alias("said"))
    return checked.unionByName(found)


def appendix(violations: DataFrame) -> DataFrame:
    """All flags by severity, under their labels."""
    label = F.col("kind")
    for k, said in fixed.ANOMALY_LABELS:
        label = F.when(F.col("kind") == k, said).otherwise(label)
    f = enumerated(violations.where("stage = 'anomaly'"), [E.severity_rank(F.col("severity"))], "violation_id")
    return f.select("idx", label.alias("type"), _said("attribute").alias("attribute"), _said("flagged_value").alias("flagged_value"), _said("expected_range").alias("expected_range"), "severity")


def document_scores(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """A report's head for each document: checks, weights, score and verdict; documents without rows have run no checks."""
    ok = F.col("classification") == "Compliant"
    s = rows.groupBy("doc_id").agg(F.count("*").alias("total_checks"), F.count_if(ok).alias("compliant_count"), F.sum("weight").alias("total_weight"), F.sum(F.when(ok, F.col("weight")).otherwise(0)).alias("compliant_weight"))
    s = documents.select("doc_id", "sector").join(s, "doc_id", "left").na.fill(0, ["total_checks", "compliant_count", "total_weight", "compliant_weight"])
    s = s.withColumns({"non_compliant_count": F.col("total_checks") - F.col("compliant_count"), "non_compliant_weight": F.col("total_weight") - F.col("compliant_weight"), "weighted_score": F.coalesce(F.round(F.try_divide(F.col("compliant_weight") * 100.0, F.col("total_weight")), 1), F.lit(0.0))})
    return s.withColumn("verdict", F.when(F.col("total_checks") == 0, "NO_CHECKS_RUN").otherwise(E.verdict(F.col("weighted_score"))))


def compliance_section(rows: DataFrame) -> DataFrame:
    """section, name, total, compliant, non_compliant, percent, place: severities in their order, categories from the worst score up."""
    s = checks.scores(rows).where("kind <> 'total'")
    percent = F.when(F.col("kind") == "severity", F.floor(F.col("compliant") * 100.0 / F.greatest("total", F.lit(1)) + 0.5).cast("double")).otherwise(F.col("category_score"))
    s = s.select(F.col("kind").alias("section"), "name", "total", "compliant", "non_compliant", percent.alias("percent"))
    order = F.when(F.col("section") == "severity", E.severity_rank(F.col("name")).cast("double")).otherwise(F.col("percent"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(order, "name")))  # a row for each standard


def executive_summary(rows: DataFrame, violations: DataFrame, score: DataFrame) -> DataFrame:
    """One row: critical and all non-compliant checks, high or critical issues and flags, and what the verdict says of the report."""
    high = F.col("severity").isin("CRITICAL", "HIGH")
    nc = F.col("classification") == "Non-Compliant"
    a = rows.agg(F.count_if(nc & (F.col("severity") == "CRITICAL")).alias("critical_non_compliant"), F.count_if(nc).alias("non_compliant"))
    b = violations.agg(F.count_if((F.col("stage") == "consistency") & high).alias("high_issues"), F.count_if((F.col("stage") == "anomaly") & high).alias("high_flags"))
    health = F.lit(fixed.HEALTH[-1][1])
    for verdict, said in fixed.HEALTH[:-1]:
        health = F.when(F.col("verdict") == verdict, said).otherwise(health)
    return a.join(b).join(score.select(health.alias("health")))  # three single rows


# ---- older reports

OLD = (
    "struct<results: array<struct<classification: string, check_area: string, category: string, dpr_value: string, rule_expected: string, standard: string, severity: string, weight: int, reason: string, source_page: int>>, "
    "findings: struct<failures: array<struct<attribute: string, standard: string, dpr_value: string, rule: string, severity: string, explanation: string, source_page: int>>, missing_parameters: array<struct<parameter: string, rule_text: string>>>>"
)
_COMMON = ("classification", "check_area", "category", "dpr_value", "rule_expected", "standard", "severity", "weight", "reason", "source_page")


def legacy_rows(reports: DataFrame) -> DataFrame:
    """report_id and checked rows of reports (report_id, raw JSON) in the present or the older form."""
    r = reports.select("report_id", F.from_json("raw", OLD).alias("r"))
    now = r.where("r.results is not null").select("report_id", F.explode("r.results").alias("x")).select("report_id", *[f"x.{c}" for c in _COMMON])
    old = r.where("r.results is null")
    weight = F.when(F.col("x.severity").isin(*fixed.SEVERITIES[:4]), E.weight(F.col("x.severity"))).otherwise(2)
    nothing = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(F.col(c))
    failed = old.select("report_id", F.explode("r.findings.failures").alias("x")).select(
        "report_id", F.lit("Non-Compliant").alias("classification"), F.col("x.attribute").alias("check_area"), F.col("x.standard").alias("category"), "x.dpr_value", F.col("x.rule").alias("rule_expected"), "x.standard", "x.severity", weight.alias("weight"),
        nothing("x.explanation", "Does not meet rule requirement.").alias("reason"), "x.source_page",
    )
    absent = old.select("report_id", F.explode("r.findings.missing_parameters").alias("x")).select(
        "report_id", F.lit("Non-Compliant").alias("classification"), F.col("x.parameter").alias("check_area"), F.lit("DPR Completeness").alias("category"), F.lit("Not found").alias("dpr_value"), F.lit("Must be present").alias("rule_expected"), F.lit("DPR Completeness").alias("standard"),
        F.lit("HIGH").alias("severity"), F.lit(3).alias("weight"), nothing("x.rule_text", "Mandatory parameter missing from DPR.").alias("reason"), F.lit(0).alias("source_page"),
    )
    return now.unionByName(failed).unionByName(absent)


def legacy_score(reports: DataFrame) -> DataFrame:
    """report_id, total_checks, compliant_count, non_compliant_count, weighted_score, verdict: whole percents, without weights; a report without rows scores 0."""
    s = legacy_rows(reports).groupBy("report_id").agg(F.count("*").alias("total_checks"), F.count_if(F.col("classification") == "Non-Compliant").alias("non_compliant_count"))
    s = reports.select("report_id").join(s, "report_id", "left").na.fill(0).withColumn("compliant_count", F.col("total_checks") - F.col("non_compliant_count"))
    s = s.withColumn("weighted_score", F.coalesce(F.floor(F.try_divide(F.col("compliant_count") * 100.0, F.col("total_checks")) + 0.5), F.lit(0)).cast("int"))
    return s.withColumn("verdict", E.verdict(F.col("weighted_score")))
