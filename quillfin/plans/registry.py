"""All queries of the engine's own operators by name, and their SQL."""

from __future__ import annotations

from . import depth_queries, grids, evaluation, guard_queries, quality_queries, replay_queries, suite_queries, training, trading  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
