"""The registered queries, grouped as the operators are."""

from importlib import import_module

MODULES = ["profiles", "cleaning", "sampling", "modelling"]


def load():
    """(queries, SQL) of all modules."""
    from riskframe.catalog import common
    for name in MODULES:
        import_module(f"riskframe.catalog.{name}")
    return common.QUERIES, common.SQL
