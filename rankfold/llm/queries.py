"""All queries of this subpackage."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry


def load():
    """Import every operator module and return the registry."""
    package = importlib.import_module(__package__)
    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{__package__}.{module.name}")
    return registry
