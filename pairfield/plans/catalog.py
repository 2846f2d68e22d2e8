"""All queries over the reference tables."""

from __future__ import annotations

from . import evaluation, features, files, flows, logs, points, sampling, surfaces, tables  # noqa: F401  they register their queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
