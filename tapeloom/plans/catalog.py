"""All registered queries, gathered by importing the plan modules."""
from __future__ import annotations

from tapeloom.plans import accounts, alignment, chain, evaluation, factors, features, indicators, labels, models, scorecards, signals, strategies, streams, structure  # noqa: F401
from tapeloom.plans.registry import COVERS, ORACLES, QUERIES, assemble


def queries():
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return {name: assemble(sql) for name, sql in ORACLES.items()}


def coverage() -> dict[str, str]:
    return dict(COVERS)
