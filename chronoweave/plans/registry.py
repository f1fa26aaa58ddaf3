"""Collects the registered queries and oracle SQL of every area."""

from __future__ import annotations

import importlib

_AREAS = ("checks_gaps", "checks_series", "checks_meta", "checks_sources")


def _mods():
    return [importlib.import_module(f"chronoweave.plans.{a}") for a in _AREAS]


def all_queries() -> dict:
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_oracle_sql() -> dict:
    out = {}
    for m in _mods():
        out.update(m.ORACLE)
    return out
