"""Queries of the coded-image operators, and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from .plans import blocks, containers, fields, headers, images, modelled, more, planes, shapes, stencils

PLANS = (blocks, planes, containers, more, stencils, shapes, fields, headers, modelled, images)


def queries() -> dict:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
