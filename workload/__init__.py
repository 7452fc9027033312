"""The registered queries, the catalogue data they derive from the given tables, and their SQL."""

from importlib import import_module

MODULES = ("measures", "loads", "names", "scripts", "catalog", "texts")


def load_queries() -> None:
    for name in MODULES:
        import_module(f"workload.{name}")
