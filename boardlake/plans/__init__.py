"""Runnable queries over the given tables, each with its SQL twin where one exists."""

from importlib import import_module

_MODULES = (
    "inspections", "curation", "lineage", "scores", "vectors", "golden", "images",
    "components", "streams", "extensions",
)


def load() -> None:
    from importlib.util import find_spec
    for name in _MODULES:
        if find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")
