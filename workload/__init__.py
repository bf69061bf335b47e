"""The registered queries over the given tables, with their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil

_SKIP = {"check", "registry", "views"}


def load():
    """Import every query module and give the register."""
    for module in pkgutil.iter_modules(__path__):
        if module.name not in _SKIP:
            importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
