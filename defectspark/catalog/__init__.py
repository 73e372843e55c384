"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from importlib import import_module

GROUPS = ["masks", "splits", "metrics", "results", "lake", "corpus", "incremental", "roundtrips"]


def load():
    """Import every query group once and return the registry."""
    for group in GROUPS:
        import_module(f"defectspark.catalog.{group}")
    return import_module("defectspark.catalog.registry")
