"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import LOWER, UPPER

#: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The vocabulary that comes with the package: a term and its weight on each line.
VOCABULARY = Path(__file__).with_name("url_terms.tsv")
#: Total weight of different terms that rejects a url. A term of this weight is strict, one of less is soft.
REJECT = 1.0


def vocabulary(path: str | Path = VOCABULARY) -> dict[str, float]:
    """Terms (of ASCII letters and digits, small) and their weights, from a file on the driver."""
    lines = [x.split("\t") for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip() and not x.startswith("#")]
    terms = {term.strip(): float(weight) for term, weight in lines}
    if bad := [t for t, w in terms.items() if not re.fullmatch("[a-z0-9]+", t) or w <= 0]:
        raise ValueError(f"terms must be small ASCII letters and digits, weights positive: {bad[:5]}")
    return terms


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end. Both are empty without ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent domain of it and whose path starts the url's; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, of, starts in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # longer ones go on the outside
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(starts)
        rule, verdict = F.when(fits, f"{of}{starts}").otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _edge(text: str, at: int) -> bool:
    """Nothing but an ASCII letter or digit continues a term."""
    return not (0 <= at < len(text)) or not (text[at].isascii() and text[at].isalnum())


def count_terms(urls: Sequence[str | None], terms: dict[str, float], machine=None) -> list[tuple[int, int, float]]:
    """(strict hits, distinct soft terms, weight of distinct terms) of each url, A-Z lower-cased; a term counts where no ASCII letter or digit adjoins it."""
    machine = machine or automaton(terms)
    fold, out = str.maketrans(UPPER, LOWER), []
    for url in urls:
        text, hard, seen = (url or "").translate(fold), 0, set()
        for end, term in machine.iter(text):
            if _edge(text, end + 1) and _edge(text, end - len(term)):
                hard += terms[term] >= REJECT
                seen.add(term)
        out.append((hard, sum(terms[t] < REJECT for t in seen), round(sum(terms[t] for t in sorted(seen)), 9)))
    return out


def automaton(terms: dict[str, float]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for t in terms:
        made.add_word(t, t)
    if terms:
        made.make_automaton()
    return made


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, terms: dict[str, float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits, weight for each row of pages.

    A rule decides where one fits; else a url whose different terms weigh REJECT together is blocked: one strict term, or
    several soft ones. Anything else is allowed. A null url has empty host and path, no hits, and is allowed.
    Urls of any length are read whole; only the two named columns are read; repeated rows each get their row; an empty table gives an
    empty result. terms: see vocabulary, which is the default.
    """
    terms = vocabulary() if terms is None else terms

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(terms)
        for b in batches:
            hits = count_terms(b.column(1).to_pylist(), terms, machine) if terms else [(0, 0, 0.0)] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([h[j] for h in hits], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.float64())))], ["_id", "_url", "strict_hits", "soft_hits", "weight"])

    thin = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    kind = thin.schema["_id"].dataType.simpleString()
    found = thin.mapInArrow(scan, f"_id {kind}, _url string, strict_hits int, soft_hits int, weight double")
    host, path = host_and_path(F.col("_url"))
    parts = found.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_terms = F.when(F.col("weight") >= REJECT, "block").otherwise("allow")
    return parts.select(F.col("_id").alias("page_id"), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_terms).alias("verdict"), "strict_hits", "soft_hits", "weight")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _hits(term: str, count: bool) -> str:
    pattern = f"(^|[^a-z0-9]){term}($|[^a-z0-9])"
    if not count:
        return f"CASE WHEN regexp_matches(u, '{pattern}') THEN 1 ELSE 0 END"
    # each separator is doubled, so that neighbouring hits do not share one
    return f"len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g'), '{pattern}'))"


_TERMS = vocabulary()
OP9_SQL = f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u FROM pages),
b AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  {" + ".join(_hits(t, True) for t, w in _TERMS.items() if w >= REJECT)} AS strict_hits,
  {" + ".join(_hits(t, False) for t, w in _TERMS.items() if w < REJECT)} AS soft_hits,
  round({" + ".join(f"{w}::DOUBLE * {_hits(t, False)}" for t, w in sorted(_TERMS.items()))}, 9) AS weight FROM b),
d AS (SELECT *, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN weight >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict,
  CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits, weight
FROM d
"""
