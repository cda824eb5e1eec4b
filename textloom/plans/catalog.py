"""All registered queries."""

from __future__ import annotations

import importlib

from textloom.plans.base import REGISTERED, Query

MODULES = ["sources", "scalars", "ledger", "corpus", "pages", "tree", "json", "terms", "guarded", "entities", "briefs", "exports", "packing", "more", "streams", "rest"]


def registered() -> dict[str, tuple[Query, str | None]]:
    for module in MODULES:
        importlib.import_module(f"textloom.plans.{module}")
    return dict(REGISTERED)
