"""Every named query of the core, with its SQL twin where SQL can say it."""

from __future__ import annotations

from hemiciclo.plans import diagnostics, relational, reports, rules
from hemiciclo.plans.registry import Registry


def merged() -> Registry:
    out = Registry()
    for part in (rules.registry, reports.registry, relational.registry, diagnostics.registry):
        out.functions.update(part.functions)
        out.sql.update(part.sql)
    return out


def queries():
    return dict(merged().functions)


def oracle_sql():
    return dict(merged().sql)
