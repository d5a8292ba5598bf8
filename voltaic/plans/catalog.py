"""All registered queries (importing a query module registers its entries)."""

from __future__ import annotations

from . import registry

_MODULES = ["listing_queries", "spec_queries", "dataset_queries", "model_queries", "source_queries", "extra_queries"]


def _load():
    import importlib
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return {k: v for k, v in registry.ORACLES.items() if k in registry.QUERIES}
