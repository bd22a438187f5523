"""Triples, nodes, edges, concepts and ontology as tables; upserts as one row per merge key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import fixed
from dossier.functions import expr as E

#: What a model answers for a piece of text.
TRIPLES, EVENTS = "triples: array<struct<Head: string, Relation: string, Tail: string>>", "events: array<struct<Event: string, Entity: array<string>>>"


def _text(c) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def parse_triples(answers: DataFrame) -> DataFrame:
    """doc_id, source_page, sector, seq, head, relation, tail, triple_type from answers (doc_id, source_page, sector, seq, raw JSON).

    Triples with a blank part are left out; each entity of an event participates in it. An answer that is no JSON says nothing.
    seq orders all triples: a place in the answer is below 1,000, triples before events.
    """
    key = ["doc_id", "source_page", "sector"]
    # an answer is read once: what a generator returns is not copied into later steps, and an outer one gets no test of its input before joins
    read = F.from_json("raw", f"struct<{TRIPLES}, {EVENTS}, bad: string>", {"columnNameOfCorruptRecord": "bad"})
    a = answers.select(*key, "seq", "raw", F.inline_outer(F.array(read)))
    # in an answer that is not wholly as expected, what is wrong with one list does not touch the other
    alone = lambda c, kind: F.when(F.col("bad").isNull(), F.col(c)).otherwise(F.from_json("raw", f"struct<{kind}>")[c])
    each = lambda c, made: F.coalesce(F.transform(c, made), F.array())
    row = lambda seq, head, relation, tail, kind: F.struct(seq.alias("seq"), _text(head).alias("head"), relation.alias("relation"), _text(tail).alias("tail"), F.lit(kind).alias("triple_type"))
    at = F.col("seq") * 1000
    facts = each(alone("triples", TRIPLES), lambda t, k: row(at + k, t["Head"], _text(t["Relation"]), t["Tail"], "entity_relation"))
    events = F.flatten(each(alone("events", EVENTS), lambda e, k: each(e["Entity"], lambda head, j: row(at + 500 + k * 20 + j, head, F.lit("participates in"), e["Event"], "event_entity"))))
    return a.select(*key, F.inline_outer(F.concat(facts, events))).where("head <> '' and relation <> '' and tail <> ''")


def kg_nodes(triples: DataFrame) -> DataFrame:
    """doc_id, entity_id, label, node_type: the first mention of a label in a document names and types it; heads of events are typed as events."""
    head = F.struct(F.col("head").alias("label"), (F.col("seq") * 2).alias("o"), F.when(F.col("triple_type") == "event_entity", "event").otherwise("entity").alias("node_type"))
    tail = F.struct(F.col("tail").alias("label"), (F.col("seq") * 2 + 1).alias("o"), F.lit("entity").alias("node_type"))
    ends = triples.select("doc_id", F.inline(F.array(head, tail)))
    # numbers are combined by hash; only the few spellings of a label are sorted
    spelled = ends.groupBy("doc_id", F.lower("label").alias("name"), "label", "node_type", F.isnull("o")).agg(F.min("o").alias("o"))
    first = spelled.groupBy("doc_id", "name").agg(F.min(F.struct("o", "label", "node_type")).alias("m"))
    return first.select("doc_id", F.concat_ws("::", "doc_id", "name").alias("entity_id"), "m.label", "m.node_type")


def kg_edges(triples: DataFrame) -> DataFrame:
    """One edge for each (head, relation, doc, tail); the last properties win."""
    e = triples.select("doc_id", F.lower("head").alias("head"), "relation", F.lower("tail").alias("tail"), "seq", "source_page", "triple_type")
    last = e.groupBy("doc_id", "head", "relation", "tail").agg(F.max(F.struct("seq", "source_page", "triple_type")).alias("m"))
    made = lambda c: F.concat_ws("::", "doc_id", c).alias(f"{c}_id")
    return last.select("doc_id", made("head"), "relation", made("tail"), F.col("m.seq").alias("last_seq"), "m.source_page", "m.triple_type")


def edge_strings(triples: DataFrame) -> DataFrame:
    """What is embedded of an edge."""
    return triples.select("doc_id", "seq", F.concat_ws(" ", "head", "relation", "tail").alias("triple_string"))


def concept_batches(triples: DataFrame) -> DataFrame:
    """doc_id, item, batch: the first entities and relations of a document that concepts are asked for, in batches.

    A document has few distinct items among its first ones: items are ranked after they are distinct, and each kind's ranks are cut.
    """
    said = lambda kind, c, o: F.struct(F.lit(kind).alias("kind"), F.lower(c).alias("item"), o.alias("o"))
    items = triples.select("doc_id", F.inline(F.array(said(0, "head", F.col("seq") * 2), said(0, "tail", F.col("seq") * 2 + 1), said(1, "relation", F.col("seq")))))
    first = items.where(F.trim("item") != "").groupBy("doc_id", "kind", "item").agg(F.min("o").alias("o"))
    # a salt bounds what one task sorts; the second step has at most 32 times the cut of a document
    most = F.when(F.col("kind") == 0, fixed.CONCEPT_ENTITIES).otherwise(fixed.CONCEPT_RELATIONS)
    cut = F.slice(F.array_sort(F.collect_list(F.struct("o", "item"))), F.lit(1), most)
    parts = first.groupBy("doc_id", "kind", F.pmod(F.xxhash64("item"), F.lit(32)).alias("s")).agg(cut.alias("b")).select("doc_id", "kind", F.explode("b").alias("x")).select("doc_id", "kind", "x.*")
    kinds = parts.groupBy("doc_id", "kind").agg(cut.alias("b")).select("doc_id", "kind", F.transform("b", lambda x: x["item"]).alias("items"))
    both = kinds.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kind", "items"))), lambda x: x["items"])).alias("items"))
    return both.select("doc_id", F.posexplode("items").alias("place", "item")).select("doc_id", "item", F.floor(F.col("place") / fixed.CONCEPT_BATCH).cast("int").alias("batch"))


def clean_concepts(labels: Column) -> Column:
    """Labels of an item: stripped, small letters, of three words at most, the first five."""
    kept = F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(_text(x))), lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= fixed.CONCEPT_WORDS))
    return F.slice(kept, 1, fixed.CONCEPTS_OF_ITEM)


def concept_nodes(concepts: DataFrame) -> DataFrame:
    """name, sector, doc_id, is_induced: one node for each concept and sector; concepts: doc_id, sector, item, concepts. The last document names it."""
    each = concepts.select("sector", "doc_id", F.explode("concepts").alias("name")).where(F.trim("name") != "")
    return each.groupBy("name", "sector").agg(F.max("doc_id").alias("doc_id")).withColumn("is_induced", F.lit(True))


def kg_stats(triples: DataFrame, concepts: DataFrame) -> DataFrame:
    """doc_id, entities, triples, concepts: nodes, edges and concept nodes of each document, zeros kept."""
    edges = triples.select("doc_id", F.lower("head").alias("head"), "relation", F.lower("tail").alias("tail")).distinct()
    # nodes are the ends of edges, and each edge counts at its head
    end = lambda c, n: F.struct(F.col(c).alias("name"), F.lit(n).alias("n"))
    nodes = edges.select("doc_id", F.inline(F.array(end("head", 1), end("tail", 0)))).groupBy("doc_id", "name").agg(F.sum("n").alias("n"))
    counts = nodes.groupBy("doc_id").agg(F.count("*").alias("entities"), F.sum("n").alias("triples"), F.lit(0).cast("long").alias("concepts"))
    named = concept_nodes(concepts).groupBy("doc_id").agg(F.lit(0).cast("long").alias("entities"), F.lit(0).cast("long").alias("triples"), F.count("*").alias("concepts"))
    return counts.unionByName(named).groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in ("entities", "triples", "concepts")])


# ---- upserts

def upsert(rows: DataFrame, key: list[str], order: str = "seq", first: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the last of everything, but the first of the columns in `first`."""
    rest = [c for c in rows.columns if c not in key and c not in first and c != order]
    found = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"), *[F.min_by(c, order).alias(c) for c in first])
    return found.select(*key, *first, "_last.*")


def document_rows(metadata: DataFrame) -> DataFrame:
    """doc_id, filename, doc_type, total_pages, sector, sector_confidence, is_scanned, page_range, source_path with defaults; the last record of a document wins."""
    rows = metadata.select(
        "seq", "doc_id", F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("doc_type", F.lit("pdf")).alias("doc_type"), F.coalesce("total_pages", F.lit(0)).alias("total_pages"), F.coalesce("sector", F.lit("")).alias("sector"),
        F.coalesce("sector_confidence", F.lit(0.0)).alias("sector_confidence"), F.coalesce("is_scanned", F.lit(False)).alias("is_scanned"), F.coalesce("page_range", F.lit("")).alias("page_range"), F.coalesce("filename", F.lit("")).alias("source_path"),
    )
    return upsert(rows, ["doc_id"])


def fact_rows(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts as stored: defaults, texts cut, the document's sector where a fact has none. Facts of unknown documents are left out.

    An id is made of what the fact says, so that a fact that is pushed again is the same row; the most confident one stays.
    """
    d = documents.select("doc_id", F.col("sector").alias("_sector"))
    text = lambda c, other="": F.coalesce(c, F.lit(other)).alias(c)
    rows = facts.join(d, "doc_id").select(
        "doc_id", text("fact_type", "parameter"), text("subject"), text("attribute"), text("value"), text("unit"), F.substring(F.coalesce("context", F.lit("")), 1, fixed.CONTEXT).alias("context"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("source_page", F.lit(0)).alias("source_page"), F.coalesce(F.nullif(_text("sector"), F.lit("")), "_sector").alias("sector"),
    )
    key = E.key_of("f_", "doc_id", "fact_type", "subject", "attribute", "value", "unit", "context", F.col("source_page").cast("string"))
    return rows.groupBy(key.alias("fact_id")).agg(F.max_by(F.struct(*rows.columns), "confidence").alias("_f")).select("fact_id", "_f.*")


def sector_edges(rows: DataFrame, id_col: str) -> DataFrame:
    """id, sector for the rows whose sector is known; the others have none."""
    known = rows.sparkSession.createDataFrame([(s,) for s in fixed.SECTORS], "sector string")
    return rows.select(id_col, "sector").join(known, "sector", "left_semi").distinct()


def rule_rows(rules: DataFrame) -> DataFrame:
    """Rules as stored: defaults, text cut."""
    text = lambda c, other="": F.coalesce(c, F.lit(other)).alias(c)
    return rules.select("seq", "rule_id", text("standard_name"), text("clause"), text("attribute"), F.substring(F.coalesce("rule_text", F.lit("")), 1, fixed.RULE_TEXT).alias("rule_text"), text("operator", "must_be"), text("threshold"), text("unit"), text("condition"), text("severity", "HIGH"), text("sector"))


def useful_rules(rules: DataFrame) -> DataFrame:
    """Rules with an attribute and a text of more than ten characters."""
    return rules.where((_text("attribute") != "") & (F.length(_text("rule_text")) > 10))


def useful_facts(facts: DataFrame) -> DataFrame:
    """Facts with a subject and a value."""
    return facts.where((F.coalesce("subject", F.lit("")) != "") & (_text("value") != ""))


def sorted_json(row: Column) -> Column:
    """A map of strings as JSON with sorted keys, a space after each comma and colon, null where a value is null."""
    # quotes, backslashes and control characters are written by to_json, which is asked for one string at a time
    quoted = lambda v: F.regexp_extract(F.to_json(F.create_map(F.lit("v"), v)), r'(?s)^\{"v":(.*)\}$', 1)
    entries = F.array_sort(F.map_entries(row))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.when(e["value"].isNull(), "null").otherwise(quoted(e["value"])))), ", "), F.lit("}"))


def table_row_facts(rows: DataFrame) -> DataFrame:
    """Table rows (doc_id, page, row_index, row map, sector) as facts. The id is made of the row's place and JSON: the same row is one fact."""
    r = rows.withColumn("value", sorted_json(F.col("row")))
    made = F.concat(F.lit("tr_"), F.substring(F.md5(F.concat_ws("_", "doc_id", F.col("page").cast("string"), F.col("row_index").cast("string"), "value").cast("binary")), 1, 16))
    return r.select(
        made.alias("fact_id"), "doc_id", F.lit("table_row").alias("fact_type"), F.lit("table").alias("subject"), F.lit("row_data").alias("attribute"), "value", F.lit("").alias("unit"), F.lit(0.85).alias("confidence"), F.col("page").alias("source_page"), "row_index", "sector"
    ).dropDuplicates(["fact_id"])


def ontology_tables(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, dependencies, entity types) from answers (doc_id, sector, seq, raw JSON): three upserts with their own keys."""
    kind = (
        "struct<classes: array<struct<name: string, description: string, example_subjects: array<string>>>, dependencies: array<struct<parameter: string, requires: string, reason: string, validation_rule: string>>, "
        "sector_specific_entities: array<struct<entity_type: string, key_parameters: array<string>, mandatory_checks: array<string>>>>"
    )
    a = answers.select("doc_id", "sector", "seq", F.from_json("raw", kind).alias("a"))
    each = lambda c: a.select("doc_id", "sector", (F.col("seq") * 1000).alias("s"), F.posexplode(f"a.{c}").alias("k", "x")).select("doc_id", "sector", (F.col("s") + F.col("k")).alias("seq"), "x.*")
    none = F.array().cast("array<string>")
    classes = each("classes").where("name is not null").select("seq", "name", "sector", "doc_id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("example_subjects", none).alias("examples"))
    deps = each("dependencies").select("seq", "sector", "doc_id", *[_text(c).alias(c) for c in ("parameter", "requires", "reason", "validation_rule")])
    types = each("sector_specific_entities").select("seq", F.coalesce("entity_type", F.lit("")).alias("name"), "sector", F.coalesce("key_parameters", none).alias("key_parameters"), F.coalesce("mandatory_checks", none).alias("mandatory_checks"), F.lit(True).alias("is_entity_type"))
    return upsert(classes, ["name", "sector", "doc_id"]), upsert(deps, ["parameter", "requires", "sector"]), upsert(types, ["name", "sector"])
