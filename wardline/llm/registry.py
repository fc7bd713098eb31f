"""Queries and oracle SQL of all operators of this subpackage, by name."""

from __future__ import annotations

import importlib

MODULES = ["pii", "minhash_dedup", "toxicity", "chat_format", "packing", "substring_dedup", "sharding", "quality_rules", "url_filter", "decontaminate",
           "whitening", "ranked_search", "best_fit"]


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"wardline.llm.{name}"), what)
    return out


QUERIES = _all("QUERIES")
ORACLE = _all("ORACLE")
