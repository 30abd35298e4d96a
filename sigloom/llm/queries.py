"""All registered queries of the operators."""

from __future__ import annotations

import importlib

_MODULES = (
    "exact_dedup", "quality_rules", "quality_classifier", "mixing", "license_scan", "packing", "substring_dedup", "jaccard_join",
    "suffix_dedup", "language_model", "source_divergence", "spelling_variants", "fingerprints",
)


def registry() -> list:
    return [q for name in _MODULES for q in importlib.import_module(f"sigloom.llm.{name}").QUERIES]
