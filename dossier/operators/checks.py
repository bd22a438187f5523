"""Consistency, anomaly, compliance and graph checks as DataFrame to DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import fixed
from dossier.functions import expr as E


def measured(facts: DataFrame) -> DataFrame:
    """Facts that are not table rows; a null type counts as neither."""
    return facts.where(F.col("fact_type") != "table_row")


# ---- cleaning

def normalise_facts(facts: DataFrame) -> DataFrame:
    return E.with_normalised_values(facts).withColumns({"subject": F.trim("subject"), "attribute": F.lower(F.trim("attribute")), "confidence": E.clamp_confidence(F.col("confidence"))})


def rejection_reason(min_confidence: float = fixed.MIN_CONFIDENCE):
    v = F.trim(F.coalesce("value", F.lit("")))
    return F.when(v == "", "empty_value").when(F.length(F.trim("subject")) < 2, "short_subject").when(F.col("confidence") < min_confidence, "low_confidence").when(v.rlike(r"^[.\-:,\s]+$"), "punctuation").otherwise("kept")


def drop_low_confidence(facts: DataFrame, least: float = fixed.MIN_CONFIDENCE) -> DataFrame:
    """Null confidence, table rows and facts without a type stay."""
    return facts.where(~F.coalesce((F.col("confidence") < least) & (F.col("fact_type") != "table_row"), F.lit(False)))


def keep_best(facts: DataFrame, key=("doc_id", "subject", "attribute", "value")) -> DataFrame:
    """The most confident fact of each key, ties by id. A minimum per key combines before the shuffle, whatever a key's size."""
    order = F.struct(-F.coalesce(F.col("confidence"), F.lit(-1.0)), F.col("fact_id"))
    return facts.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min_by(F.struct(*facts.columns), order).alias("_best")).select("_best.*")


def clean_facts(facts: DataFrame) -> DataFrame:
    """Only facts with a type other than table rows are repeated ones; the others are left as they are."""
    kept = drop_low_confidence(facts)
    return keep_best(measured(kept)).unionByName(kept.where(~F.coalesce(F.col("fact_type") != "table_row", F.lit(False))))


def duplicate_groups(facts: DataFrame) -> DataFrame:
    """Keys that several facts of a document have: how many, and the one that stays."""
    key = ("doc_id", "subject", "attribute", "value")
    order = F.struct(-F.coalesce(F.col("confidence"), F.lit(-1.0)), F.col("fact_id"))
    return measured(facts).groupBy(*key).agg(F.count("*").alias("n"), F.min_by("fact_id", order).alias("keep_id")).where("n > 1")


# ---- consistency

def _mismatch_facts(facts: DataFrame) -> DataFrame:
    subject, n = F.lower(F.trim("subject")), E.numeric_loose(F.col("value"))
    used = measured(facts).select("fact_id", "doc_id", subject.alias("subject"), E.canonical_attribute(F.col("attribute")).alias("attribute"), n.alias("n"), "source_page")
    return used.where(F.col("n").isNotNull() & ~F.col("subject").isin(*fixed.GENERIC_SUBJECTS))


def numeric_mismatch(facts: DataFrame) -> DataFrame:
    g = _mismatch_facts(facts).groupBy("doc_id", "subject", "attribute").agg(F.count("*").alias("n_facts"), F.countDistinct("source_page").alias("n_pages"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    g = g.where((F.col("n_facts") >= 2) & (F.col("n_pages") >= 2) & (F.col("hi") != 0)).withColumn("spread", (F.col("hi") - F.col("lo")) / F.col("hi"))
    return g.where(F.col("spread") > fixed.SPREAD).withColumn("severity", F.when(F.col("spread") > fixed.SPREAD_HIGH, "HIGH").otherwise("MEDIUM"))


def usable_dependencies(dependencies: DataFrame) -> DataFrame:
    """Texts stripped, nulls as nothing; both sides at least two characters."""
    clean = dependencies.select("sector", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("parameter", "requires", "reason", "rule")])
    return clean.where((F.length("parameter") >= 2) & (F.length("requires") >= 2))


def missing_dependency(facts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Dependencies whose parameter a document mentions and whose prerequisite it does not.

    A mention is a substring of an attribute or subject, so distinct names of a document meet the dependencies of
    its sector once; a maximum per dependency combines before the shuffle.
    """
    names = facts.select("doc_id", "sector", F.lower("attribute").alias("name")).union(facts.select("doc_id", "sector", F.lower("subject").alias("name"))).distinct()
    met = names.join(usable_dependencies(dependencies), "sector")
    met = met.withColumns({"p": F.col("name").contains(F.lower("parameter")), "r": F.col("name").contains(F.lower("requires"))})
    found = met.groupBy("doc_id", "sector", "parameter", "requires", "reason", "rule").agg(F.max("p").alias("p"), F.max("r").alias("r")).where("p and not r")
    said = lambda s: E.fill(s, **{c: F.col(c) for c in ("parameter", "requires", "reason", "rule")})
    return found.select("doc_id", "sector", "parameter", "requires", F.lit("HIGH").alias("severity"), said(fixed.PREREQUISITE).alias("description"), said(fixed.EVIDENCE).alias("evidence"))


# ---- anomalies

def statistical_outlier(facts: DataFrame) -> DataFrame:
    """|z| > 3 within (document, sector, attribute), at least four numbers.

    A deviation counts as none up to 1e-12 of the mean: sums of floats leave so much where exact arithmetic leaves 0.
    """
    used = measured(facts).select("fact_id", "doc_id", "sector", F.lower(F.trim("attribute")).alias("attribute"), E.numeric_loose(F.col("value")).alias("n")).where("n is not null")
    key = ["doc_id", "sector", "attribute"]
    stats = used.groupBy(*key).agg(F.count("*").alias("k"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd")).where("k >= 4 and sd > 1e-12 * greatest(abs(mean), 1)")
    z = used.join(stats, key).withColumn("z", F.abs(F.col("n") - F.col("mean")) / F.col("sd")).where(F.col("z") > fixed.SIGMA)
    low, high = (F.round(F.col("mean") + k * F.col("sd"), 2) for k in (-2, 2))
    return z.select("fact_id", *key, "n", F.round("z", 6).alias("z"), low.alias("expected_low"), high.alias("expected_high"), F.when(F.col("z") > fixed.SIGMA_HIGH, "HIGH").otherwise("MEDIUM").alias("severity"))


def oom_error(facts: DataFrame) -> DataFrame:
    a, n = F.lower(F.coalesce("attribute", F.lit(""))), E.numeric_loose(F.col("value"))
    bounds = None
    for keyword, low, high, unit in fixed.KNOWN_RANGES:
        row = F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.lit(unit).alias("unit"))
        bounds = F.when(a.contains(keyword), row) if bounds is None else bounds.when(a.contains(keyword), row)
    signed = reduce(lambda x, y: x | y, [a.contains(s) for s in fixed.SIGNED_ATTRIBUTES])
    f = measured(facts).select("fact_id", "doc_id", a.alias("attribute"), n.alias("n"), bounds.alias("b"), signed.alias("signed")).where("n <> 0 and not signed")
    return f.where((F.col("n") < F.col("b.low") / fixed.MAGNITUDE) | (F.col("n") > F.col("b.high") * fixed.MAGNITUDE)).select("fact_id", "doc_id", "attribute", "n", F.col("b.low").alias("low"), F.col("b.high").alias("high"), F.lit("HIGH").alias("severity"))


def duplicate_values(facts: DataFrame, share: float = fixed.DUPLICATE_SHARE) -> DataFrame:
    counts = measured(facts).select("doc_id", F.lower(F.trim("attribute")).alias("attribute"), F.trim("value").alias("value")).where("attribute <> ''").groupBy("doc_id", "attribute", "value").agg(F.count("*").alias("k"))
    g = counts.groupBy("doc_id", "attribute").agg(F.sum("k").alias("n"), F.max(F.struct("k", "value")).alias("m"))
    return g.where((F.col("n") >= 4) & (F.col("m.k") / F.col("n") >= share)).select("doc_id", "attribute", "n", F.col("m.k").alias("modal_count"), F.col("m.value").alias("flagged_value"), F.lit("MEDIUM").alias("severity"))


def unit_mismatch(facts: DataFrame) -> DataFrame:
    u = F.regexp_replace(F.lower(F.trim("unit")), " ", "")
    g = measured(facts).where("unit <> ''").groupBy("doc_id", F.lower(F.trim("attribute")).alias("attribute")).agg(F.array_sort(F.collect_set(F.when(u.isin(*[x for f in fixed.UNIT_FAMILIES for x in f]), u))).alias("units"))
    met = None
    for family in fixed.UNIT_FAMILIES:
        both = F.array_intersect("units", F.array(*map(F.lit, family)))
        met = F.when(F.size(both) >= 2, both) if met is None else met.when(F.size(both) >= 2, both)
    return g.withColumn("mixed", F.array_join(F.array_sort(met), ",")).where("mixed is not null").select("doc_id", "attribute", "mixed", F.lit("MEDIUM").alias("severity"))


# ---- rules

def attribute_pairs(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct attributes of which one contains the other. Nested loops run over names, not over facts; Spark's own size check decides what is broadcast."""
    fa, ra = facts.select(F.lower("attribute").alias("f_attr")).distinct(), rules.select(F.lower("attribute").alias("r_attr")).distinct()
    return fa.join(ra, F.col("f_attr").contains(F.col("r_attr")) | F.col("r_attr").contains(F.col("f_attr")))


def fact_rule_pairs(facts: DataFrame, rules: DataFrame, rule_sectors: DataFrame, applicable: DataFrame) -> DataFrame:
    """One row for each fact, rule and sector by which the rule applies to it. A rule's condition must be in the fact's context."""
    f = measured(facts).withColumn("f_attr", F.lower("attribute"))
    r = rules.withColumn("r_attr", F.lower("attribute")).withColumnsRenamed({"attribute": "rule_attribute", "unit": "rule_unit"})
    by_sector = applicable.join(rule_sectors.withColumnRenamed("sector", "applies"), "applies").join(r, "rule_id")
    holds = (F.coalesce("cond", F.lit("")) == "") | F.lower("context").contains(F.lower("cond"))
    return f.join(attribute_pairs(facts, rules), "f_attr").join(by_sector, ["sector", "r_attr"]).where(holds)


def compliance_rows(pairs: DataFrame, how: str = "rule") -> DataFrame:
    """Pairs of facts and rules as checked rows: what was found, what is expected, the verdict and why."""
    severity = F.when(F.coalesce("severity", F.lit("")) == "", "HIGH").otherwise(F.col("severity"))
    p = pairs.withColumns({
        "severity": severity, "dpr_value": F.trim(F.concat_ws(" ", F.coalesce("value", F.lit("")), F.coalesce("unit", F.lit("")))),
        "rule_expected": E.describe_operator(F.col("operator"), F.col("threshold"), F.col("rule_unit")), "_ok": E.compare(F.col("value"), F.col("operator"), F.col("threshold")),
    })
    said = lambda s: E.fill(s, attribute=F.col("attribute"), dpr_value=F.col("dpr_value"), rule_expected=F.col("rule_expected"), std=F.col("standard_name"), clause=F.col("clause"))
    return p.select(
        E.key_of("c_", F.lit(how), "fact_id", "rule_id", F.coalesce("applies", F.lit(""))).alias("row_id"), "fact_id", "rule_id", "applies", "doc_id", "sector",
        E.title_case(F.col("rule_attribute")).alias("check_area"), F.col("standard_name").alias("category"), F.trim(F.concat_ws(" ", "standard_name", "clause")).alias("standard"),
        "severity", F.when(F.col("_ok"), "Compliant").otherwise("Non-Compliant").alias("classification"), F.col("_ok").isNull().alias("needs_review"), E.weight(F.col("severity")).alias("weight"),
        "source_page", "dpr_value", "rule_expected", F.when(F.col("_ok"), said(fixed.MEETS)).when(~F.col("_ok"), said(fixed.FAILS)).otherwise(said(fixed.UNDECIDED)).alias("reason"),
    )


def scores(rows: DataFrame) -> DataFrame:
    """Totals, per severity and per category in one pass: kind, name, total, compliant, non_compliant, weight, compliant_weight, category_score.

    Severities other than the four main ones count in the totals only.
    """
    ok = F.when(F.col("classification") == "Compliant", 1).otherwise(0)
    base = rows.select("severity", F.when(F.coalesce("category", F.lit("")) == "", "Uncategorised").otherwise(F.col("category")).alias("area"), ok.alias("ok"), "weight")
    g = base.groupingSets([["severity"], ["area"], []], "severity", "area").agg(F.grouping("severity").alias("gs"), F.grouping("area").alias("ga"), F.count("*").alias("total"), F.coalesce(F.sum("ok"), F.lit(0)).alias("compliant"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.coalesce(F.sum(F.col("ok") * F.col("weight")), F.lit(0)).alias("compliant_weight"))
    kind = F.when(F.col("gs") == 0, "severity").when(F.col("ga") == 0, "category").otherwise("total")
    g = g.select(kind.alias("kind"), F.coalesce("severity", "area", F.lit("")).alias("name"), "total", "compliant", (F.col("total") - F.col("compliant")).alias("non_compliant"), "weight", "compliant_weight", F.round(F.try_divide(F.col("compliant") * 100.0, F.col("total")), 1).alias("category_score"))
    return g.where((F.col("kind") != "severity") | F.col("name").isin(*fixed.SEVERITIES[:4]))


def by_severity(rows: DataFrame) -> DataFrame:
    return scores(rows).where("kind = 'severity'").select(F.col("name").alias("severity"), "total", "compliant", "non_compliant", "weight", "compliant_weight")


def by_category(rows: DataFrame) -> DataFrame:
    return scores(rows).where("kind = 'category'").select(F.col("name").alias("category"), "total", "compliant", "non_compliant", "category_score")


def total_score(rows: DataFrame) -> DataFrame:
    """One row, also for no rows at all."""
    ok = F.col("classification") == "Compliant"
    s = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("compliant"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total_weight"), F.coalesce(F.sum(F.when(ok, F.col("weight"))), F.lit(0)).alias("compliant_weight"))
    s = s.withColumns({"non_compliant": F.col("total") - F.col("compliant"), "non_compliant_weight": F.col("total_weight") - F.col("compliant_weight"), "score": F.coalesce(F.round(F.try_divide(F.col("compliant_weight") * 100.0, F.col("total_weight")), 1), F.lit(0.0))})
    return s.withColumn("verdict", F.when(F.col("total") == 0, "NO_CHECKS_RUN").otherwise(E.verdict(F.col("score"))))


# ---- vectors

#: Numbers of probe vectors that tasks hold at once; more probes take several passes over the items.
PROBE_NUMBERS = 1 << 22


def _met(items: DataFrame, probes: DataFrame, pick, probe_numbers: int) -> DataFrame:
    """probe_id, item_id, score of what pick(scores, items' ids) marks in the (probes, items) cosines of each batch.

    Both sides are (vec_id, embedding). The probes are counted first: so many as fit in a task's memory go to the tasks at
    once, the others in further passes. A batch of items meets them in one matrix product.
    """
    size = probes.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // probe_numbers))
    kinds = [dict(f.dtypes)["vec_id"] for f in (probes, items)]
    out = None
    for block in range(blocks):
        part = probes.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block) if blocks > 1 else probes
        table = part.select("vec_id", "embedding").toArrow()
        ids, y = table.column(0).combine_chunks(), _unit_rows(table.column(1).combine_chunks())

        def scan(batches: Iterator[pa.RecordBatch], ids=ids, y=y) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows if len(ids) else 0, 2048):
                    own, x = b.column(0)[lo : lo + 2048], _unit_rows(b.column(1)[lo : lo + 2048])
                    score = np.round(y @ x.T, 9)
                    at, item = np.nonzero(pick(score, own.to_numpy(zero_copy_only=False)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), own.take(pa.array(item)), pa.array(score[at, item])], ["probe_id", "item_id", "score"])

        met = items.select("vec_id", "embedding").mapInArrow(scan, f"probe_id {kinds[0]}, item_id {kinds[1]}, score double")
        out = met if out is None else out.unionByName(met)
    return out


def vector_topk(items: DataFrame, probes: DataFrame, k: int, least: float = -2.0, probe_numbers: int = PROBE_NUMBERS) -> DataFrame:
    """probe_id, item_id, score, rank: the k nearest items of each probe by cosine, ties by id; zero vectors have cosine 0 with all.

    A batch sends on its k best for each probe, so what is ranked at the end does not grow with the items.
    """

    def pick(score: np.ndarray, own: np.ndarray) -> np.ndarray:
        near = score >= (np.maximum(np.partition(score, -k, axis=1)[:, -k], least)[:, None] if len(own) > k else least)
        for j in np.flatnonzero(near.sum(axis=1) > k):  # ties: the smallest ids
            tied = np.flatnonzero(near[j])
            near[j] = False
            near[j, sorted(tied, key=lambda t: (-score[j, t], own[t]))[:k]] = True
        return near

    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id"))), 1, k)
    # in two steps, so that no task has all of a probe's rows
    first = _met(items, probes, pick, probe_numbers).groupBy("probe_id", F.pmod(F.xxhash64("item_id"), F.lit(32)).alias("part")).agg(best.alias("best"))
    ranked = first.select("probe_id", F.explode("best").alias("b")).select("probe_id", "b.*").withColumn("score", -F.col("s")).groupBy("probe_id").agg(best.alias("best"))
    return ranked.select("probe_id", F.posexplode("best").alias("rank", "b")).select("probe_id", F.col("b.item_id").alias("item_id"), (-F.col("b.s")).alias("score"), (F.col("rank") + 1).alias("rank"))


def vector_pairs(items: DataFrame, probes: DataFrame, least: float, probe_numbers: int = PROBE_NUMBERS) -> DataFrame:
    """probe_id, item_id, score: all pairs whose cosine is at least `least`."""
    return _met(items, probes, lambda score, own: score >= least, probe_numbers)


def nearest_probe(items: DataFrame, probes: DataFrame, least: float, probe_numbers: int = PROBE_NUMBERS) -> DataFrame:
    """item_id, score: the cosine of each item's nearest probe, from `least` on."""
    return _met(items, probes, lambda score, own: (score >= least) & (score == score.max(axis=0)), probe_numbers).groupBy("item_id").agg(F.max("score").alias("score"))


def _unit_rows(vectors: pa.Array) -> np.ndarray:
    """(n, d) rows of length 1; zero rows stay."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


# ---- rules as stored

def upsert_rules(rules: DataFrame) -> DataFrame:
    """Per (standard, clause, attribute): the first id, the last of everything else. See rule_sector_edges for the sectors, which add up."""
    return rules.groupBy("standard_name", "clause", "attribute").agg(F.min_by("rule_id", "seq").alias("rule_id"), F.max_by("operator", "seq").alias("operator"), F.max_by("threshold", "seq").alias("threshold"), F.max_by("severity", "seq").alias("severity"))


def rule_sector_edges(rules: DataFrame, rule_sectors: DataFrame) -> DataFrame:
    """rule_id, sector: every sector under which a rule with the same merge key was ever stored."""
    key = ["standard_name", "clause", "attribute"]
    first = rules.groupBy(*key).agg(F.min_by("rule_id", "seq").alias("kept"))
    return rules.select("rule_id", *key).join(first, key).join(rule_sectors, "rule_id").select(F.col("kept").alias("rule_id"), "sector").distinct()


# ---- table rows

def table_rows(part: DataFrame) -> DataFrame:
    """part as extracted table rows: row_index, row map; some cells blanked, some rows repeating their header."""
    k = F.col("p_partkey")
    cell = lambda c, m: F.when(k % 10 >= m, F.when(k % 3 == 0, "  ").otherwise("nan")).otherwise(F.col(c).cast("string"))
    header = k % 13 == 0
    names = ("p_name", "p_brand", "p_type", "p_size")
    row = F.create_map(*[x for n, m in zip(names, (9, 8, 8, 7)) for x in (F.lit(n), F.when(header, F.lit(n)).otherwise(cell(n, m)))])
    return part.select(k.alias("row_index"), row.alias("row"))


def _blank(v):
    return v.isNull() | F.trim(v).isin(*fixed.NULL_TEXTS)


def fill_rate(rows: DataFrame) -> DataFrame:
    """Share of a row's cells that are neither null nor blank; words for nothing fill a cell."""
    v = F.map_values("row")
    return rows.withColumn("fill_rate", F.coalesce(F.try_divide(F.size(F.filter(v, lambda x: x.isNotNull() & (F.trim(x) != ""))), F.size(v)), F.lit(0.0)))


def filter_table_rows(rows: DataFrame) -> DataFrame:
    """Drops empty rows, repeated headers and rows with more than 80 % of their cells blank."""
    v, k = F.map_values("row"), F.map_keys("row")
    full = F.transform(F.filter(v, lambda x: ~_blank(x)), lambda x: F.trim(x))
    return rows.where((F.size(v) > 0) & (full != F.transform(k, lambda x: F.trim(x))) & (F.size(full) > 0) & ((F.size(v) - F.size(full)) / F.size(v) <= 0.8))
