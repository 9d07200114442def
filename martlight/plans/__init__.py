"""Named queries and their SQL counterparts for the checker."""

from __future__ import annotations

from martlight.plans import imports, published, reports, upkeep
from martlight.session import tune

MODULES = (reports, imports, published, upkeep)


def _tuned(build):
    return lambda spark, folder: build(tune(spark), folder)


def all_queries() -> dict:
    return {name: _tuned(build) for module in MODULES for name, build in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}
