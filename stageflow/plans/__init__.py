"""Runnable queries, one module per area."""

import importlib

from stageflow.plans.registry import REGISTRY

MODULES = ("flow", "profile_quality", "joins", "scalars", "scans", "scoring", "learning", "monitoring", "streams")

for _m in MODULES:
    importlib.import_module(f"stageflow.plans.{_m}")

__all__ = ["REGISTRY"]
