"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from glossa.llm import alignment, decontamination, fingerprints, html_text, line_dedup, mixing, prefix_trie, quality, simhash, suffix_dedup, token_counts, token_output, toxicity

MODULES = (mixing, fingerprints, decontamination, token_counts, simhash, suffix_dedup, line_dedup, toxicity, token_output, html_text, prefix_trie, alignment, quality)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
