"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query -> module of this package that has a function of the query's name (and ORACLE_SQL, where there is SQL).
MODULES = {
    "op1_mixing": "mixing",
    "op3_html_text": "html_text",
    "op2_token_counts": "token_counts",
    "op5_licenses": "licenses",
    "op4_packing": "packing",
    "op9_near_dedup": "near_dedup",
    "op6_pii": "pii",
    "op8_warc": "warc",
    "op10_ann": "ann",
    "op7_quality_rules": "quality_rules",
}


def queries() -> dict:
    return {name: getattr(import_module(f"bitloom.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"bitloom.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
