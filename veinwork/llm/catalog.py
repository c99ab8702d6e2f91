"""The queries of these operators and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_secret_scan": "secrets_scan",
    "op2_sentencepiece": "pieces",
    "op3_minhash_dedup": "dedup",
    "op4_quality": "quality",
    "op5_decontaminate": "decontaminate",
    "op6_exact_topk": "topk",
    "op7_language_id": "language",
    "op8_html_extract": "pages",
    "op9_lm_score": "lm",
    "op10_token_counts": "tokens",
    "op11_ngram_join": "ngram_join",
    "op12_merkle_manifest": "manifest",
    "op13_hard_negatives": "negatives",
}


def _modules() -> dict:
    return {k: importlib.import_module(f"veinwork.llm.{m}") for k, m in MODULES.items()}


def queries() -> dict:
    return {k: m.query for k, m in _modules().items()}


def oracle_sql() -> dict:
    return {k: m.ORACLE for k, m in _modules().items() if getattr(m, "ORACLE", None)}
