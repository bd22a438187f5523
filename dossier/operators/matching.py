"""Rules and parameters that words alone do not find: nearest vectors, word overlap, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import fixed
from dossier.functions import expr as E
from dossier.operators import checks


def said(facts: DataFrame) -> DataFrame:
    """fact_id, text: attribute and subject of each fact that is not a table row."""
    return checks.measured(facts).select("fact_id", "doc_id", F.trim(F.concat_ws(" ", F.coalesce("attribute", F.lit("")), F.coalesce("subject", F.lit("")))).alias("text"))


def unmatched_rules(documents: DataFrame, rules: DataFrame, rule_sectors: DataFrame, applicable: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, rule_id, attribute: rules that apply to a document (doc_id, sector) and that pairs (doc_id, rule_id) lack for it."""
    asked = documents.join(applicable, "sector").join(rule_sectors.withColumnRenamed("sector", "applies"), "applies").select("doc_id", "rule_id").distinct()
    return asked.join(pairs.select("doc_id", "rule_id").distinct(), ["doc_id", "rule_id"], "left_anti").join(rules.select("rule_id", "attribute"), "rule_id").select("doc_id", "rule_id", "attribute")


def second_pass(facts: DataFrame, unmatched: DataFrame, vectors: DataFrame, least: float = fixed.SEMANTIC_RULE) -> DataFrame:
    """doc_id, fact_id, rule_id, score: for each rule that a document has no match for, its fact whose text is nearest to the rule's attribute, from `least` on.

    unmatched: doc_id, rule_id, attribute. vectors: text, embedding, of attributes and of facts' texts; what has none matches nothing.
    Distinct texts meet distinct attributes; of the facts that say the nearest text, the one with the smallest id is taken.
    """
    texts = said(facts)
    attributes = unmatched.select(F.col("attribute").alias("text")).distinct().join(vectors, "text").select(F.col("text").alias("vec_id"), "embedding")
    known = texts.select("text").distinct().join(vectors, "text").select(F.col("text").alias("vec_id"), "embedding")
    near = checks.vector_pairs(known, attributes, least).select(F.col("probe_id").alias("attribute"), F.col("item_id").alias("text"), "score")
    first = texts.groupBy("doc_id", "text").agg(F.min("fact_id").alias("fact_id"))
    met = near.join(first, "text").join(unmatched, ["doc_id", "attribute"])
    best = met.groupBy("doc_id", "rule_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "fact_id")).alias("b"))
    return best.select("doc_id", "b.fact_id", "rule_id", (-F.col("b.s")).alias("score"))


def second_pass_pairs(facts: DataFrame, rules: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of second_pass as compliance_rows takes them."""
    r = rules.withColumnsRenamed({"attribute": "rule_attribute", "unit": "rule_unit"})
    return facts.join(found.drop("doc_id"), "fact_id").join(r, "rule_id").withColumn("applies", F.lit(None).cast("string"))


def gated_facts(facts: DataFrame, vectors: DataFrame, edges: DataFrame, k: int = 3, least: float = fixed.SEMANTIC_GATE) -> DataFrame:
    """fact_id, similarity: facts one of whose k nearest rulebook edges scores at least `least`; edges: vec_id, embedding.

    Each distinct text is a probe of its own. A rulebook's edges are the smaller side, so they go to the tasks and
    the texts stream by them: the best edge decides, whatever k is.
    """
    texts = said(facts).where("text <> ''")
    known = texts.select("text").distinct().join(vectors, "text").select(F.col("text").alias("vec_id"), "embedding")
    best = checks.nearest_probe(known, edges, least)
    return texts.join(best.select(F.col("item_id").alias("text"), F.col("score").alias("similarity")), "text").select("fact_id", "similarity")


def overlapping_rule(attributes: DataFrame, rules: DataFrame, least: float = fixed.WORD_OVERLAP) -> DataFrame:
    """sector, attribute, rule_id, overlap: the sector's rule whose attribute shares most words, the first among equals, from `least` on.

    Of rules with the same attribute the last counts. Distinct attributes meet rules by the words that they share; one that
    shares none has no overlap. attributes: sector, attribute; rules: sector, rule_id, attribute, seq.
    """
    key = F.lower(F.trim(F.coalesce("attribute", F.lit(""))))
    r = rules.withColumn("r_attr", key).where("r_attr <> ''").groupBy("sector", "r_attr").agg(F.max_by("rule_id", "seq").alias("rule_id"), F.min("seq").alias("place"))
    a = attributes.select("sector", "attribute").distinct().withColumn("f_attr", F.lower("attribute"))
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != "")))
    met = a.withColumn("word", words("f_attr")).join(r.withColumn("word", words("r_attr")), ["sector", "word"]).select("sector", "attribute", "f_attr", "r_attr", "rule_id", "place").distinct()
    met = met.withColumn("overlap", E.word_jaccard(F.col("f_attr"), F.col("r_attr")))
    best = met.groupBy("sector", "attribute").agg(F.min_by(F.struct("rule_id", "overlap"), F.struct(-F.col("overlap"), F.col("place"))).alias("b"))
    return best.select("sector", "attribute", "b.*").where(F.col("overlap") >= least)


def gate_and_overlap(facts: DataFrame, rules: DataFrame, rule_sectors: DataFrame, applicable: DataFrame, vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts that the rulebook's edges let through, with the rule of most word overlap among those that apply: the pairs that compliance_rows takes, and similarity and overlap."""
    of_sector = applicable.join(rule_sectors.withColumnRenamed("sector", "applies"), "applies").select("sector", "rule_id").distinct().join(rules.select("rule_id", "attribute", "seq"), "rule_id")
    let = checks.measured(facts).join(gated_facts(facts, vectors, edges), "fact_id")
    r = rules.withColumnsRenamed({"attribute": "rule_attribute", "unit": "rule_unit"})
    return let.join(overlapping_rule(let, of_sector), ["sector", "attribute"]).join(r, "rule_id").withColumn("applies", F.lit(None).cast("string"))


def merge_by_rule(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows, and of `more` the first row (by fact) of each document's rule that rows do not have."""
    new = more.join(rows.select("doc_id", "rule_id").distinct(), ["doc_id", "rule_id"], "left_anti").select(more.columns)
    first = new.groupBy("doc_id", "rule_id").agg(F.min_by(F.struct(*new.columns), F.col("fact_id")).alias("r")).select("r.*")
    return rows.unionByName(first)


def present(text, parameter, term_lists) -> tuple:
    """Whether a text states a parameter: by its name or a synonym, or by all words of a name of several."""
    low = F.lower(parameter)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return F.exists(F.concat(F.array(low), term_lists), lambda t: text.contains(t)) | ((F.size(F.array_distinct(words)) > 1) & F.forall(words, lambda w: text.contains(w)))


def completeness(facts: DataFrame, documents: DataFrame, parameters: DataFrame, applicable: DataFrame, vectors: DataFrame, least: float = fixed.SEMANTIC_PARAMETER) -> DataFrame:
    """doc_id, parameter, entity, ...: mandatory parameters that no fact of a document states, as rows like compliance_rows' ones.

    documents: doc_id, sector. Parameters of the sector and its parents count once, under the first that names them. A
    text states a parameter by words (see present; synonyms are looked up by the name as written) or by a vector at least `least` near.
    """
    synonyms = F.create_map(*[x for p, other in fixed.PARAMETER_SYNONYMS for x in (F.lit(p), F.array(*map(F.lit, other)))])
    p = parameters.withColumn("terms", F.coalesce(F.element_at(synonyms, F.col("parameter")), F.array().cast("array<string>"))).withColumn("pkey", F.lower(F.trim("parameter")))
    asked = documents.join(applicable, "sector").join(p.withColumnRenamed("sector", "applies"), "applies")
    order = F.struct((F.col("applies") != F.col("sector")).cast("int"), F.col("applies"), F.col("entity"), F.col("k"))
    asked = asked.groupBy("doc_id", "sector", "pkey").agg(F.min_by(F.struct("parameter", "entity", "terms"), order).alias("a")).select("doc_id", "sector", "pkey", "a.*")
    texts = said(facts).select("doc_id", F.lower("text").alias("low"), "text").distinct()
    by_words = texts.join(asked.select("doc_id", "pkey", "parameter", "terms"), "doc_id").where(present(F.col("low"), F.col("parameter"), F.col("terms"))).select("doc_id", "pkey").distinct()
    left = asked.join(by_words, ["doc_id", "pkey"], "left_anti")
    probes = left.select("parameter").distinct().join(vectors, F.col("parameter") == F.col("text")).select(F.col("parameter").alias("vec_id"), "embedding")
    known = texts.select("text").distinct().join(vectors, "text").select(F.col("text").alias("vec_id"), "embedding")
    near = checks.vector_pairs(known, probes, least)
    by_vector = near.select(F.col("item_id").alias("text"), F.col("probe_id").alias("parameter")).join(texts, "text").select("doc_id", "parameter").distinct()
    missing = left.join(by_vector, ["doc_id", "parameter"], "left_anti")
    return missing.select(
        "doc_id", "sector", "parameter", "entity", E.title_case(F.col("parameter")).alias("check_area"), F.concat("entity", F.lit(" – Completeness")).alias("category"), F.lit("Non-Compliant").alias("classification"),
        F.lit("Not found in DPR").alias("dpr_value"), F.lit("Parameter must be present").alias("rule_expected"), F.lit("DPR Completeness / Ontology").alias("standard"), F.lit("HIGH").alias("severity"), F.lit(3).alias("weight"), F.lit(0).alias("source_page"),
    )
