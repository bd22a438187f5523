"""Queries of this subpackage and their DuckDB twins."""

from dossier.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_language_id": language_id.op4_language_id,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_token_counts": token_counts.op10_token_counts,
}
ORACLES = {"op3_ngram_join": ngram_join.OP3_SQL, "op5_substring_dedup": substring_dedup.OP5_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op8_suffix_dedup": suffix_dedup.OP8_SQL, "op9_url_filter": url_filter.OP9_SQL}
