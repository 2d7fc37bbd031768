"""All queries of the engine but those of the training-data subpackage."""

from __future__ import annotations

from gritstone.plans import catalogue, effects, evidence, families, fits, frameworks, review, robustness, scoring, selection, series, shape
from gritstone.plans.registry import Query

_REGISTRIES = (evidence.REGISTRY, frameworks.REGISTRY, robustness.REGISTRY, families.REGISTRY, fits.REGISTRY, selection.REGISTRY, series.REGISTRY, effects.REGISTRY, scoring.REGISTRY, shape.REGISTRY)


def queries() -> dict[str, Query]:
    out = {**catalogue.queries(), **review.queries()}
    for registry in _REGISTRIES:
        out |= registry.queries
    return out


def oracle_sql() -> dict[str, str]:
    out = {**catalogue.oracle_sql(), **review.oracle_sql()}
    for registry in _REGISTRIES:
        out |= registry.sql
    return out
