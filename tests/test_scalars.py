"""Scalar semantics, by table."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import expr as E


def values(spark, build, rows, names):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} string" for n in names))
    return [r.out for r in df.select("k", build.alias("out")).orderBy("k").collect()]


def test_units(spark):
    rows = {"kmph": "km/h", "Sec.": "s", "Cum": "m³", "Sqm": "m²", "Km": "km", "furlong": "furlong", " kph ": "km/h"}
    assert values(spark, E.canonical_unit(F.col("u")), [(u,) for u in rows], ["u"]) == list(rows.values())


@pytest.mark.parametrize("value,unit,said", [("7,500", "mm", ("7.5", "m")), ("2", "Km", ("2000", "m")), ("3", "MPa", ("3000", "kN/m²")), ("1234567", "", ("1.23457e+06", "")), ("approx 7.5", "m", ("7.5", "m")), ("approximately 7.5", "m", ("imately7.5", "m")), ("pile foundation", "", ("pilefoundation", ""))])
def test_values(spark, value, unit, said):
    df = spark.createDataFrame([(value, unit)], "value string, unit string")
    assert tuple(E.with_normalised_values(df).first()) == said


def test_numbers(spark):
    loose = {"M30": 30.0, "5.3 m, 7.8 m": None, "1.23457e+06": 1.2345706, "-": None, "": None}
    assert values(spark, E.numeric_loose(F.col("v")), [(v,) for v in loose], ["v"]) == list(loose.values())
    strict = {"160 kmph": 160.0, "5-10": None, "5 to 5": 5.0, "none": None}
    assert values(spark, E.numeric_strict(F.col("v")), [(v,) for v in strict], ["v"]) == list(strict.values())
    confidence = {"1.7": 1.0, "x": 0.5, None: 0.5, "0.2": 0.2}
    assert values(spark, E.clamp_confidence(F.col("v")), [(v,) for v in confidence], ["v"]) == list(confidence.values())


def test_attributes(spark):
    rows = {"Headway in sec.": "headway", "No. of stations": "station_count", "Design speed limit": "design_speed", "cost": "cost"}
    assert values(spark, E.canonical_attribute(F.col("a")), [(a,) for a in rows], ["a"]) == list(rows.values())


def test_compare(spark):
    rows = [("160", ">=", "150", True), ("10", "in_range", "5-10", None), ("5", "in_range", "5 to 5", True), ("M30 grade", "must_be", "grade", True), ("m", "must_not_be", "m", False), ("IV", "==", "Standard-IV", True), ("5", "must_be", "5", None), ("x", ">=", "3", None), ("Standard-IV", "==", "IV for 160", None), ("3", "<", "2", False)]
    assert values(spark, E.compare(F.col("v"), F.col("o"), F.col("t")), [r[:3] for r in rows], ["v", "o", "t"]) == [r[3] for r in rows]
