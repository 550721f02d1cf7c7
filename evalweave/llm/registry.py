"""Queries and SQL of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["line_dedup", "quality_knn", "decontaminate", "prefix_free", "ngram_join", "token_files", "packing", "url_filter", "preferences", "flac_column", "conversation_repair", "html_text", "token_alignment"]


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"evalweave.llm.{m}").QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"evalweave.llm.{m}").ORACLE.items()}
