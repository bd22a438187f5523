"""Checks on small frames with boundary values, and the catalogue against DuckDB on the driver tables."""

import os

import duckdb
import pytest

from dossier.operators import checks, pages
from dossier.plans import catalogue

SF = "/root/testdata/sf0.001"
FACT = "fact_id string, doc_id string, sector string, fact_type string, subject string, attribute string, value string, unit string, confidence double, source_page int"


def facts(spark, rows):
    return spark.createDataFrame([(str(k), "d", "s", "m", r.get("subject", "pier a"), r.get("attribute", "span"), r.get("value", "1"), r.get("unit", "m"), r.get("confidence", 0.9), r.get("page", k)) for k, r in enumerate(rows)], FACT)


@pytest.mark.parametrize("n,severity", [(10, None), (11, "MEDIUM"), (23, "HIGH")])
def test_outlier_needs_rows(spark, n, severity):
    got = checks.statistical_outlier(facts(spark, [{"value": "5"}] * (n - 1) + [{"value": "6"}])).collect()
    assert [r.severity for r in got] == ([severity] if severity else [])


@pytest.mark.parametrize("value,attribute,flagged", [("0.05", "span", True), ("3001", "span", True), ("3000", "span", False), ("0", "span", False), ("99999", "overlay span", False), ("99999", "pile depth", False)])
def test_magnitude(spark, value, attribute, flagged):
    assert checks.oom_error(facts(spark, [{"value": value, "attribute": attribute}])).count() == flagged


@pytest.mark.parametrize("same,total,flagged", [(17, 20, True), (16, 20, False), (3, 3, False)])
def test_duplicates(spark, same, total, flagged):
    assert checks.duplicate_values(facts(spark, [{"value": "7"}] * same + [{"value": str(100 + k)} for k in range(total - same)])).count() == flagged


@pytest.mark.parametrize("values,severity", [(("89", "100"), "MEDIUM"), (("60", "100"), "HIGH"), (("-10", "-20"), None)])
def test_mismatch(spark, values, severity):
    assert [r.severity for r in checks.numeric_mismatch(facts(spark, [{"value": v} for v in values])).collect()] == ([severity] if severity else [])
    assert checks.numeric_mismatch(facts(spark, [{"value": v, "subject": "station"} for v in values])).count() == 0


def test_cleaning(spark):
    f = facts(spark, [{"confidence": 0.45}, {"confidence": 0.4499}, {"confidence": None, "subject": "x"}, {"confidence": 0.9, "value": "1"}])
    assert sorted(r.fact_id for r in checks.clean_facts(f).collect()) == ["2", "3"]


def test_chunks():
    text = " ".join(f"w{k}" for k in range(400))
    parts = pages.chunks_of(text, 200, 30)
    assert all(len(p) <= 200 for p in parts) and set(" ".join(parts).split()) == set(text.split())
    assert pages.chunks_of(None, 10, 2) == [] and pages.chunks_of("a b", 10, 2) == ["a b"]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_catalogue(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    want = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    text = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(text, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(text, r)) for r in want.fetchall())
