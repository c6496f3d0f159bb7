"""All registered queries."""
from importlib import import_module

from tickloom.plans.registry import ORACLES, QUERIES

MODULES = ("intake", "features", "training", "exploring", "scoring", "outlook", "operations")

for _name in MODULES:
    import_module(f"tickloom.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
