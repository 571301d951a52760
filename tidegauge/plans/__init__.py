"""Whole plans (monitoring, evaluation, adaptation) and the named queries over the test tables."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every ``over_*`` module, so that its queries are in the catalog."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("over_"):
            importlib.import_module(f"{__name__}.{module.name}")
