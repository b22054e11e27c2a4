"""All queries of the subpackage; importing a module registers its queries."""

from __future__ import annotations

import importlib

from offerlens.llm.common import OPS

MODULES = ("langid", "linededup", "simhash", "decontaminate", "pieces", "tokencount", "quality", "licenses", "neighbours", "suffixdedup", "merkle", "bytepairs", "centroids")


def load() -> dict:
    for name in MODULES:
        importlib.import_module(f"offerlens.llm.{name}")
    return dict(OPS)
