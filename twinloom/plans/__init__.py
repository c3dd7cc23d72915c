"""Query catalogue of the engine."""

from __future__ import annotations

import importlib
import pkgutil
from types import ModuleType


def load_all() -> ModuleType:
    """Imports every module of this package, so that its queries are registered, and returns the catalogue."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.catalog")
