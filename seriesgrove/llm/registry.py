"""All queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fim, html_text, langid, licenses, mixing, multi_index, prefix_trie, secrets, simhash, token_counts, warc

MODULES = (licenses, html_text, mixing, exact_dedup, token_counts, decontaminate, secrets, langid, warc, simhash, prefix_trie, fim, multi_index)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
