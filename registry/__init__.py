"""Registered queries, grouped as the operators are."""

from __future__ import annotations

import importlib

from registry.base import CHECKS, QUERIES

MODULES = ["q_text", "q_search", "q_segment", "q_pages", "q_plan"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"registry.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_checks():
    _load()
    return dict(CHECKS)
