"""All registered queries by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("profiles", "cleaning", "features", "charts", "models", "sources")


def all_queries() -> dict:
    out: dict = {}
    for name in MODULES:
        found = import_module(f"{__name__}.{name}").QUERIES
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"query name(s) registered twice: {sorted(clash)}")
        out.update(found)
    return out
