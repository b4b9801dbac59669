"""Registered queries: the operators applied to the supplied tables."""

from __future__ import annotations

import importlib

from ledgerline.registry import REGISTRY, Query

MODULES = ["flagship", "sources", "contracts", "joins", "aggregates", "sequence", "topk", "reconcile", "scalars",
           "signal", "graph", "assign", "timetable", "replay", "sampling", "audits", "streams"]


def load() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(REGISTRY)
