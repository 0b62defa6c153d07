"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
