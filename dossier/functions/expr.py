"""Scalar semantics as Column builders; everything stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import fixed

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def first_match(c: Column, table: Iterable[tuple], value: int = 1, otherwise: Column | None = None) -> Column:
    """The table's value at the first pattern that c matches, in order."""
    out = None
    for row in table:
        v = F.lit(row[value])
        out = F.when(c.rlike(row[0]), v) if out is None else out.when(c.rlike(row[0]), v)
    return out if otherwise is None else out.otherwise(otherwise)


def number(c: Column) -> Column:
    """A float as written, else null."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def canonical_unit(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return first_match(t, fixed.UNIT_SPELLINGS, otherwise=t)


def _short(s: Column) -> Column:
    return F.regexp_replace(F.when(s.contains("."), F.regexp_replace(s, "0+$", "")).otherwise(s), r"\.$", "")


def with_normalised_values(df: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """value without commas, white space and approximations; converted when numeric, printed with six digits as C's %g does.

    Each step is a column of its own: one nested expression would repeat its parts in every branch.
    """
    v = F.regexp_replace(F.coalesce(F.col(value), F.lit("")), r"[,\s]", "")
    df = df.withColumns({"_v": F.regexp_replace(v, r"(?i)approx\.?|about|~|±[0-9]*", ""), "_u": canonical_unit(F.col(unit))})
    df = df.withColumns({"_x": number(F.col("_v")), "_m": first_match(F.col("_u"), fixed.UNIT_CONVERSIONS, 2), "_c": first_match(F.col("_u"), fixed.UNIT_CONVERSIONS, 1)})
    df = df.withColumn("_y", F.when(F.col("_m").isNotNull(), F.round(F.col("_x") * F.col("_m"), 6)).otherwise(F.col("_x")))
    df = df.withColumn("_e", F.format_string("%.5e", "_y")).withColumn("_p", F.substring_index("_e", "e", -1).try_cast("int"))
    plain = None
    for p in range(-4, 6):
        said = F.format_string(f"%.{5 - p}f", "_y")
        plain = F.when(F.col("_p") == p, said) if plain is None else plain.when(F.col("_p") == p, said)
    df = df.withColumn("_g", plain.otherwise(F.substring_index("_e", "e", 1))).withColumn("_g", _short(F.col("_g")))
    far = (F.col("_p") < -4) | (F.col("_p") >= 6)
    g = F.when(far, F.concat("_g", F.lit("e"), F.substring_index("_e", "e", -1))).otherwise(F.col("_g"))
    is_number = F.col("_x").isNotNull()
    return df.withColumns({value: F.when(is_number, g).otherwise(F.col("_v")), unit: F.when(is_number, F.coalesce("_c", "_u")).otherwise(F.col("_u"))}).drop("_v", "_u", "_x", "_m", "_c", "_y", "_e", "_p", "_g")


def clamp_confidence(c: Column) -> Column:
    x = number(F.trim(c.cast("string")))
    return F.when(x.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def numeric_loose(c: Column) -> Column:
    """What is left as a number once all but digits, dots and minus signs are gone."""
    return number(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9.\-]", ""))


def numeric_strict(c: Column) -> Column:
    """The one number that the text holds, null if it holds none or several different ones."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.try_cast("double")))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def canonical_attribute(c: Column) -> Column:
    a = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return first_match(a, [(f"^(?:{p})", v) for p, v in fixed.ATTRIBUTE_NAMES], otherwise=a)


def describe_operator(op: Column, threshold: Column, unit: Column) -> Column:
    u = F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise("")
    said = lambda a, b="", with_unit=True: F.concat(F.lit(a), threshold, F.lit(b), u if with_unit else F.lit(""))
    return (
        F.when(op == ">=", said("at least ")).when(op == "<=", said("no more than ")).when(op == ">", said("greater than ")).when(op == "<", said("less than "))
        .when(op == "==", said("exactly ")).when(op == "in_range", said("within range ")).when(op == "must_be", said("must be '", "'", False))
        .when(op == "must_not_be", said("must not be '", "'", False)).when(op == "requires", said("requires '", "'", False)).when(op == "every", said("every "))
        .when(op == "before", said("before ", "", False)).when(op == "after", said("after ", "", False)).otherwise(F.concat(op, F.lit(" "), threshold, u))
    )


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """Whether value meets (op, threshold); null where that cannot be said."""
    v, t = F.coalesce(value, F.lit("")), F.coalesce(threshold, F.lit(""))
    a, b = numeric_strict(v), numeric_strict(t)
    parts = F.transform(F.regexp_extract_all(t, F.lit("([0-9.]+)"), 1), number)
    lv, lt = F.lower(F.trim(v)), F.lower(F.trim(t))
    by_number = (
        F.when(op == ">=", a >= b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == "<", a < b).when(op == "==", F.abs(a - b) < 1e-9)
        .when((op == "in_range") & (F.size(parts) >= 2), (a >= F.get(parts, 0)) & (a <= F.element_at(parts, -1)))
    )
    alike = (lv == lt) | lv.contains(lt) | lt.contains(lv)
    by_text = F.when((op == "==") & ~t.rlike("[0-9]") & alike, True).when(op == "must_be", lv.contains(lt)).when(op == "must_not_be", ~lv.contains(lt))
    return F.when(a.isNotNull() & b.isNotNull(), by_number).otherwise(by_text)


def fill(sentence: str, **columns: Column) -> Column:
    """sentence with each {name} replaced by its column; nulls read as nothing."""
    parts = re.split(r"{(\w+)}", sentence)
    return F.concat(*[F.coalesce(columns[x].cast("string"), F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(parts) if x])


def title_case(c: Column) -> Column:
    """A capital after anything but a letter, small letters elsewhere."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))), "")


def word_jaccard(a: Column, b: Column) -> Column:
    """Share of the different words of both texts that they have in common."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def key_of(prefix: str, *columns: Column | str) -> Column:
    """An id that the same values always get."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", F.lit(prefix), *columns), 256), 1, 16))


def severity_rank(severity: Column) -> Column:
    out = None
    for k, s in enumerate(fixed.SEVERITIES):
        out = F.when(severity == s, k) if out is None else out.when(severity == s, k)
    return out.otherwise(len(fixed.SEVERITIES))


def weight(severity: Column) -> Column:
    out = None
    for s, w in fixed.SEVERITY_WEIGHTS:
        out = F.when(severity == s, w) if out is None else out.when(severity == s, w)
    return out.otherwise(fixed.DEFAULT_WEIGHT)


def verdict(score: Column) -> Column:
    out = None
    for least, said in fixed.VERDICTS:
        out = F.when(score >= least, said) if out is None else out.when(score >= least, said)
    return out


def hits(text: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(p).cast("int")
    return out
