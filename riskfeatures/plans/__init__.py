"""Composed plans: wide feature tables and the registered query catalogue."""

import importlib

_MODULES = ("q_core", "q_pit", "q_analytics", "q_aggs", "q_quality", "q_ml", "q_stats", "q_encode", "q_sources", "q_models", "q_current", "q_contract", "q_more")


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
