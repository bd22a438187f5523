"""Driver tables as the engine's tables, and the small inline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import fixed

FACT_SQL = """SELECT CAST(event_id AS STRING) AS fact_id, CONCAT('doc', CAST(user_id % 5 AS STRING)) AS doc_id,
 CASE user_id % 5 WHEN 0 THEN 'Metro' WHEN 1 THEN 'Bridges' WHEN 2 THEN 'Highways' WHEN 3 THEN 'Tunnels' ELSE 'Ports' END AS sector,
 CASE WHEN event_id % 20 = 0 THEN 'table_row' WHEN event_id % 23 = 1 THEN NULL ELSE 'measurement' END AS fact_type, CASE WHEN event_id % 41 = 0 THEN 'Station' ELSE CONCAT('pier ', CAST(user_id AS STRING)) END AS subject,
 CASE WHEN event_id % 11 = 5 THEN 'concrete grade' ELSE CASE event_type WHEN 'click' THEN 'design speed' WHEN 'error' THEN 'pile diameter' WHEN 'purchase' THEN 'span' WHEN 'signup' THEN 'bearing capacity' ELSE 'gradient' END END AS attribute,
 CASE WHEN event_id % 110 = 5 THEN 'M40' WHEN event_id % 11 = 5 THEN 'M30' WHEN event_id % 50 = 7 THEN CONCAT('approx ', CAST(value AS STRING)) WHEN event_id % 97 = 3 THEN 'Standard-IV' ELSE CAST(value AS STRING) END AS value,
 CASE event_id % 4 WHEN 0 THEN 'mm' WHEN 1 THEN 'm' WHEN 2 THEN 'km' ELSE 'kmph' END AS unit,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS confidence, CAST(day(ts) AS INT) AS source_page,
 CASE WHEN event_id % 3 = 0 THEN CONCAT('Surveyed by Night at ', CAST(user_id AS STRING)) WHEN event_id % 3 = 1 THEN 'by day' END AS context FROM {events}"""

def _sql(v) -> str:
    return "CAST(NULL AS STRING)" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


#: rule_id, seq, standard_name, clause, attribute, operator, threshold, unit, condition, severity, sectors of the rule
RULES = (
    ("r01", 1, "RDSO", "4.1", "speed", ">=", "80", "km/h", None, "CRITICAL", ("Metro", "Rail Infrastructure")),
    ("r02", 2, "IRC:5", "2.3", "span", "<=", "100", "m", "", "HIGH", ("Bridges", "Highways")),
    ("r03", 3, "IRC:78", "7.1", "pile diameter", ">", "40", "mm", None, "MEDIUM", ("Highways",)),
    ("r04", 4, "ITA", "1.1", "gradient", "<", "60", "%", None, "LOW", ("Tunnels",)),
    ("r05", 5, "IRC:6", "3.2", "bearing capacity of soil", "must_be", "standard", "", None, "INFO", ("Bridges",)),
    ("r06", 6, "RDSO", "4.2", "pile diameter of pier", "==", "Standard-IV", "", None, "HIGH", ("Rail Infrastructure",)),
    ("r07", 7, "PIANC", "9", "span", "in_range", "5 to 5", "m", None, "ODD", ("Ports",)),
    ("r08", 8, "PIANC", "10", "draught", "requires", "survey", "", None, "HIGH", ("Ports",)),
    ("r09", 9, "MoRTH", "3", "design speed", "must_not_be", "iv", "", "night", "MEDIUM", ("Highways",)),
    ("r10", 10, "RDSO", "4.1", "speed", ">=", "90", "km/h", None, "HIGH", ("Metro",)),
    ("r11", 11, "DMRC", "7.2", "capacity bearing", ">=", "30", "kN/m²", None, "", ("Metro",)),
    ("r12", 12, "", "", "concrete grade", "==", "M30", "", "DAY", "LOW", ("Highways", "Rail Infrastructure")),
    ("r13", 13, "IRC:5", "2.4", "track width", "every", "2", "km", None, "HIGH", ("Bridges",)),
    ("r14", 14, "NATM", "1", "gradient", "before", "opening", "", None, "MEDIUM", ("Tunnels",)),
    ("r15", 15, "NATM", "2", "span", "after", "opening", "", None, "MEDIUM", ("Tunnels",)),
)


RULE_SQL = " UNION ALL ".join(f"SELECT {_sql(r[0])} AS rule_id, {r[1]} AS seq, " + ", ".join(f"{_sql(v)} AS {n}" for v, n in zip(r[2:10], ("standard_name", "clause", "attribute", "operator", "threshold", "unit", "cond", "severity"))) for r in RULES)
RULE_SECTOR_SQL = " UNION ALL ".join(f"SELECT {_sql(r[0])} AS rule_id, {_sql(s)} AS sector" for r in RULES for s in r[10])
APPLICABLE_SQL = " UNION ALL ".join([f"SELECT {_sql(s)} AS sector, {_sql(s)} AS applies" for s in fixed.SECTORS] + [f"SELECT {_sql(a)} AS sector, {_sql(b)} AS applies" for a, b in fixed.SECTOR_PARENTS])
#: parameter, requires, reason, rule, sector
DEPENDENCIES = (
    ("design speed", "gradient", "curves", "R1", "Metro"),
    ("pile", "soil investigation", "bearing", "R2", "Bridges"),
    (" span ", "hydraulic study", "scour", None, "Highways"),
    ("gradient", "ventilation", None, "R4", "Tunnels"),
    ("bearing capacity", "settlement", "soil", "R5", "Tunnels"),
    ("concrete", "curing", "strength", "R6", "Ports"),
    ("span", "pier 3", "load", "R7", "Ports"),
    ("viaduct", "foundation", "load", "R8", "Ports"),
    ("x", "foundation", "load", "R9", "Ports"),
    ("concrete grade", "cover", "durability", "R10", "Metro"),
    ("design speed", "superelevation", "curves", "R11", "Bridges"),
    (None, "cover", "durability", "R12", "Metro"),
)
DEPENDENCY_SQL = " UNION ALL ".join("SELECT " + ", ".join(f"{_sql(v)} AS {n}" for v, n in zip(r, ("parameter", "requires", "reason", "rule", "sector"))) for r in DEPENDENCIES)
#: sector, entity, parameters that its reports must state
ONTOLOGY = (
    ("Metro", "Alignment", ("design speed", "curve radius", "HFL")),
    ("Rail Infrastructure", "Track", ("Curve radius", "gradient", "track km")),
    ("Bridges", "Bridge", ("carriageway width", "scour depth", "span length")),
    ("Highways", "Road", ("gradient", "estimated cost")),
    ("Tunnels", "Tunnel", ("speed design", "ventilation")),
    ("Ports", "Berth", ("draught", "capacity bearing")),
)


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One local relation. A union of one-row selects would have every later expression copied into each of its branches."""
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    casts = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", "))
    return spark.sql(f"SELECT {casts} FROM VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f" AS t({names})")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a fact (facts_all), from events."""
    return spark.sql(FACT_SQL.format(events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def rules(spark: SparkSession) -> DataFrame:
    return _values(spark, [r[:10] for r in RULES], "rule_id string, seq int, standard_name string, clause string, attribute string, operator string, threshold string, unit string, cond string, severity string")


def rule_sectors(spark: SparkSession) -> DataFrame:
    return _values(spark, [(r[0], x) for r in RULES for x in r[10]], "rule_id string, sector string")


def applicable_sectors(spark: SparkSession) -> DataFrame:
    """sector, applies: itself and its direct parents."""
    return _values(spark, [(x, x) for x in fixed.SECTORS] + list(fixed.SECTOR_PARENTS), "sector string, applies string")


def dependencies(spark: SparkSession) -> DataFrame:
    return _values(spark, list(DEPENDENCIES), "parameter string, requires string, reason string, rule string, sector string")


def mandatory_parameters(spark: SparkSession) -> DataFrame:
    """sector, entity, k, parameter: what the ontology's entity types must state."""
    return _values(spark, [(s, e, k, p) for s, e, ps in ONTOLOGY for k, p in enumerate(ps)], "sector string, entity string, k int, parameter string")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("page_num"), "text", (F.col("doc_id") % 60).alias("rect_count"), (F.col("doc_id") % 4).alias("image_count"), (F.col("doc_id") % 7 == 0).alias("has_grid_lines"), (F.col("doc_id") % 13).alias("line_count"))


ANSWER_SQL = """SELECT CONCAT('doc', CAST(l_orderkey % 3 AS STRING)) AS doc_id, CAST(l_linenumber AS INT) AS source_page, 'Metro' AS sector, l_orderkey * 10 + l_linenumber AS seq,
 CASE WHEN l_orderkey % 101 = 0 THEN 'no answer' ELSE to_json(named_struct('triples', array(named_struct('Head', CONCAT(' ', s_name), 'Relation', 'supplies', 'Tail', CASE WHEN l_orderkey % 17 = 0 THEN ' ' ELSE p_name END)),
 'events', CASE WHEN l_linenumber = 2 THEN array(named_struct('Event', CONCAT('Order ', CAST(l_orderkey % 100 AS STRING)), 'Entity', array(s_name, '', upper(p_name)))) END)) END AS raw
 FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model might say of each line item: a triple, an event on second lines, sometimes nothing of use."""
    return spark.sql(ANSWER_SQL, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier", "part")})


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sector, item, labels: what a model might call each part."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    labels = F.array(F.col("p_type"), F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.lit(""), F.concat_ws(" ", "p_type", "p_brand", F.lit("of this kind")), F.concat_ws(" ", F.lit("Size"), F.col("p_size").cast("string")), F.lit(None).cast("string"), F.lit("Item"), F.lit("good"), F.lit("thing"))
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("doc"), (F.col("p_partkey") % 3).cast("string")).alias("doc_id"), F.when(F.col("p_size") % 2 == 0, "Metro").otherwise("Ports").alias("sector"), F.lower("p_name").alias("item"), labels.alias("labels"))


DOCUMENTS = (("doc0", "Metro"), ("doc1", "Bridges"), ("doc2", "Highways"), ("doc3", "Tunnels"), ("doc4", "Ports"))
#: text, number of the vector that stands for it
TEXT_VECTORS = (("draught", 14), ("capacity bearing", 21), ("track width", 33), ("HFL", 40), ("span length", 52), ("ventilation", 33), ("estimated cost", 61), ("curve radius", 75), ("track km", 499), ("carriageway width", 3), ("scour depth", 90))


def documents(spark: SparkSession) -> DataFrame:
    return _values(spark, list(DOCUMENTS), "doc_id string, sector string")


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text, embedding: a vector for some attributes and parameters, and for each text of a fact that ends in a number, by that number and its length."""
    v = vectors(spark, sf_dir)
    said = facts(spark, sf_dir).select(F.concat_ws(" ", "attribute", "subject").alias("text")).distinct()
    number = F.regexp_extract("text", "([0-9]+)$", 1)
    said = said.where(number != "").select("text", ((number.cast("int") * 7 + F.length("text")) % 500).alias("vec_id"))
    return said.unionByName(_values(spark, list(TEXT_VECTORS), "text string, vec_id int")).join(v, "vec_id").select("text", "embedding")


def rulebook_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("vec_id < 20")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
