"""Extracted tables: column names, rows as maps, and the choice among several extractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import fixed

ROWS = "array<map<string,string>>"


def column_names(header: Column) -> Column:
    """Names without blanks (col_1, col_2, ... by their place) and repeats (name_2, name_3, ...)."""
    named = F.transform(header, lambda x, i: F.when(F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("", "nan", "none"), F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(F.trim(x)))

    def numbered(x, i):
        k = F.size(F.filter(F.slice(named, 1, i + 1), lambda y: y == x))
        return F.when(k == 1, x).otherwise(F.concat(x, F.lit("_"), k.cast("string")))

    return F.transform(named, numbered)


def rows_of(cells: Column) -> Column:
    """Rows of a table (array of arrays) whose first row names its columns, as maps; blank cells are null."""
    names = column_names(F.element_at(cells, 1))
    return F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: F.map_from_arrays(names, F.transform(names, lambda _, i: F.when(F.trim(F.get(r, i)) == "", F.lit(None)).otherwise(F.get(r, i)))))


def fill_rate(rows: Column) -> Column:
    """Share of the cells of all rows that are neither null nor blank; 0 without cells."""
    values = F.flatten(F.transform(rows, lambda r: F.map_values(r)))
    return F.coalesce(F.try_divide(F.size(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))), F.size(values)), F.lit(0.0))


def cascade(*stages: Column, least: float = fixed.TABLE_FILL) -> Column:
    """The first extraction that fills its cells well enough, else the last, whatever it is."""
    out = F.coalesce(stages[-1], F.array().cast(ROWS))
    for s in reversed(stages[:-1]):
        out = F.when((F.coalesce(F.size(s), F.lit(0)) > 0) & (fill_rate(s) >= least), s).otherwise(out)
    return out
