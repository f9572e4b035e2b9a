"""Registered queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

import importlib

#: name: module of this package that has the function of that name, and ORACLE where SQL can express it.
MODULES = {
    "op1_packing": "packing",
    "op2_bpe": "bpe",
    "op3_minhash": "minhash",
    "op4_suffix": "suffix",
    "op5_sharding": "sharding",
    "op6_chat": "chat",
    "op7_secrets": "secrets",
    "op8_quality": "quality",
    "op9_embeddings": "embeddings",
    "op10_html": "html",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"spanalign.llm.{m}"), name) for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    mods = {name: importlib.import_module(f"spanalign.llm.{m}") for name, m in MODULES.items()}
    return {name: mod.ORACLE for name, mod in mods.items() if getattr(mod, "ORACLE", None)}
