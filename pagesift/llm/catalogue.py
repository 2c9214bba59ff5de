"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module
from pathlib import Path

QUERIES: dict = {}
SQL: dict = {}
for _file in sorted(Path(__file__).parent.glob("p[0-9]*_queries.py")):
    _module = import_module(f"pagesift.llm.{_file.stem}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
