"""Registered queries by subject, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib

SUBJECTS = ["sequences", "governance", "selection", "laboratory", "records", "jobs", "files", "plans"]


def _all(name: str) -> dict:
    out: dict = {}
    for s in SUBJECTS:
        out |= getattr(importlib.import_module(f"candela.queries.{s}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
