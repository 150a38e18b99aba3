"""The operators' queries over the documents tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that holds the function of that name (and SQL, if any).
MODULES = {
    "op1_simhash_near_dedup": "simhash",
    "op2_quality_classifier": "quality",
    "op3_document_fingerprints": "merkle",
    "op4_benchmark_decontamination": "decontamination",
    "op5_source_mixing": "mixing",
    "op6_line_dedup": "line_dedup",
    "op7_substring_dedup": "substring_dedup",
    "op8_secret_scan": "secret_scan",
    "op9_toxicity": "toxicity",
    "op10_language_id": "language_id",
}


def queries() -> dict:
    return {name: getattr(import_module(f"tidemark.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tidemark.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {k: v for k, v in found.items() if v}
