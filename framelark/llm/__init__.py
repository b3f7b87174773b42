"""Operations for large-scale training-data preparation. Nothing outside this subpackage imports it."""
from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> function of session and folder) and ORACLE (name -> DuckDB SQL).
MODULES = ["substrings", "packing", "jaccard", "language", "lm", "pieces", "gif", "secrets", "html", "neighbours", "clustering", "quality", "divergence"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__name__}.{m}").ORACLE.items()}
