"""Registered queries: each module holds QUERIES (name -> callable(spark, sf_dir)) and SQL (name -> text)."""

from __future__ import annotations

import importlib
import pkgutil


def sets() -> list:
    """All query modules of this package, in name order."""
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]
