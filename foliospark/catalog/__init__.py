"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from foliospark.catalog.inputs import ORACLES, QUERIES

SECTIONS = ("search", "text", "corpus", "answers", "streams")

for _section in SECTIONS:
    import_module(f"foliospark.catalog.{_section}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
