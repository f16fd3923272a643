"""All queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from glossa.plans import answers, corpora, editorial, library, quotations, relations, retrieval, serving, sources, texts

MODULES = (retrieval, relations, corpora, texts, editorial, library, quotations, sources, answers, serving)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
