"""Registered training-data queries; modules are read like those of ``docloom.plans``."""

from __future__ import annotations

import importlib
import pkgutil

_SETS = [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if m.name.startswith("p")]
QUERIES = {name: query for one in _SETS for name, query in one.QUERIES.items()}
SQL = {name: sql for one in _SETS for name, sql in one.SQL.items()}
