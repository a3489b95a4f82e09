"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

import importlib

MODULES = ["q_layout", "q_relations", "q_profile", "q_color", "q_findings", "q_evidence", "q_text", "q_sources"]


def load_all():
    """Import every query module; returns (queries, oracle SQL)."""
    from . import registry
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLE
