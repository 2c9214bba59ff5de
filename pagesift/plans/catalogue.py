"""The queries of the engine's own operators and their SQL."""

from __future__ import annotations

from importlib import import_module
from pathlib import Path

QUERIES: dict = {}
SQL: dict = {}
for _file in sorted(Path(__file__).parent.glob("q_*.py")):
    _module = import_module(f"pagesift.plans.{_file.stem}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
