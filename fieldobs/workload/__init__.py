"""The registered queries: operators applied to the given tables, each with its SQL."""

import importlib

THEMES = ("series", "live", "periods", "collection", "streams", "stores")


def load():
    """Import every theme and return the registry."""
    for theme in THEMES:
        importlib.import_module(f"fieldobs.workload.{theme}")
    return importlib.import_module("fieldobs.workload.registry")
