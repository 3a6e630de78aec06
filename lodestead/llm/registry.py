"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query -> module of this subpackage that defines it.
QUERIES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op2_sharding": "sharding",
    "op3_near_dedup": "near_dedup",
    "op4_token_counts": "token_files",
    "op5_quality_rules": "quality_rules",
    "op6_html_wrappers": "html_wrappers",
    "op7_mixing": "mixing",
    "op8_media_columns": "media",
    "op9_bpe_automaton": "bpe_automaton",
    "op10_warc": "warc",
    "op11_token_alignment": "alignment",
    "op12_token_archive": "token_archive",
    "op13_lexical_search": "lexical_search",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{QUERIES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).ORACLE for name in QUERIES if hasattr(_module(name), "ORACLE")}
