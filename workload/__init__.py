"""Queries over the driver tables, and SQL that computes the same on another engine."""

from importlib import import_module

MODULES = ["rules", "records", "parts", "results", "batches"]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"workload.{name}"), attribute))
    return found


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")
