"""Queries over the driver tables, grouped by subject."""

from __future__ import annotations

import importlib

from millwarden.plans.catalog import ORACLES, QUERIES, Builder

SUBJECTS = (
    "profile_queries",
    "risk_queries",
    "metric_queries",
    "document_queries",
    "source_queries",
    "model_queries",
    "stream_queries",
)


def _load() -> None:
    for subject in SUBJECTS:
        importlib.import_module(f"millwarden.plans.{subject}")


def all_queries() -> dict[str, Builder]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
