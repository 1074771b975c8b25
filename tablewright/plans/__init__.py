"""Registered queries, one module per family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every module of this package and return the registry."""
    from tablewright.plans import registry

    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if info.name != "registry":
            importlib.import_module(f"{__name__}.{info.name}")
    return registry.REGISTRY
