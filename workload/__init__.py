"""Registered queries over the driver's tables, each with its SQL twin where one exists."""

from __future__ import annotations

import importlib

_MODULES = (
    "sequence_queries", "selection_queries", "distance_queries", "evaluation_queries", "learning_queries",
    "model_queries", "report_queries", "job_queries",
)


def registry() -> list:
    found = []
    for name in _MODULES:
        found.extend(importlib.import_module(f"workload.{name}").REGISTRY)
    names = [q.name for q in found]
    if len(names) != len(set(names)):
        raise ValueError("query names must be unique")
    return found
