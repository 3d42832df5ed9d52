"""The registered queries."""

from gazeframe.catalog import aggregates, derived, ingest, live, models, rows  # noqa: F401
from gazeframe.catalog.registry import REGISTRY

__all__ = ["REGISTRY"]
