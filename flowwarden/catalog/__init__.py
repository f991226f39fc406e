"""Registered queries over the test tables and their SQL counterparts."""

from importlib import import_module

from flowwarden.catalog import registry

PARTS = ("scans", "policy", "quality", "rulebook", "memory", "learning", "streams")


def load():
    """(queries, oracles) with every part of the catalogue registered."""
    for part in PARTS:
        import_module(f"flowwarden.catalog.{part}")
    return registry.QUERIES, registry.ORACLES
