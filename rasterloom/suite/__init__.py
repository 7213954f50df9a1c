"""Checked queries, grouped by operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    """All queries and their SQL, in module order."""
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name.startswith("checks_"):
            importlib.import_module(f"{__name__}.{m.name}")
    from rasterloom.suite.registry import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
