"""Imports every query module, so that the registry is complete."""

import importlib
import pkgutil

import callstrata.plans as _plans
from callstrata.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__) if m.name.startswith("q_")):
    importlib.import_module(f"callstrata.plans.{_m}")

__all__ = ["QUERIES", "ORACLES"]
