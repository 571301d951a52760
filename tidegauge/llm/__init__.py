"""Operators for large training corpora; nothing else in the library imports this package."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every ``query_*`` module, so that its queries are in this package's catalog."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("query_"):
            importlib.import_module(f"{__name__}.{module.name}")
