"""Query plans over the test tables, by group."""

from __future__ import annotations

import importlib

GROUPS = ("problems", "bars", "vol", "pairs", "forecasts", "quotes", "texts", "studies", "basics", "feeds", "panels")


def registries() -> list:
    return [importlib.import_module(f"tideglass.plans.{g}").R for g in GROUPS]
