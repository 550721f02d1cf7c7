"""All registered queries and oracles, gathered from the family modules."""

from __future__ import annotations

import importlib

FAMILIES = [
    "scoring_queries",
    "log_queries",
    "text_queries",
    "split_queries",
    "rollup_queries",
    "thread_queries",
    "gate_queries",
    "source_queries",
]


def _modules():
    return [importlib.import_module(f"evalweave.plans.{name}") for name in FAMILIES]


def all_queries() -> dict:
    out: dict = {}
    for module in _modules():
        out.update(module.QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out.update(module.ORACLE)
    return out
