"""Registered queries and their reference SQL."""

from registry import features, pool, reports, screening, training  # noqa: F401
from registry.base import REGISTRY

__all__ = ["REGISTRY"]
