"""The queries of this subpackage and their SQL, gathered from the operators' modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("op1_bpe", "op2_exact", "op3_tokens", "op4_packing", "op5_omh", "op6_simhash", "op7_pii", "op8_shards", "op9_toxicity", "op10_quality", "op11_fim", "op12_merkle", "op13_html")


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for m in MODULES:
        found |= importlib.import_module(f"formloom.llm.{m}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found |= importlib.import_module(f"formloom.llm.{m}").SQL
    return found
