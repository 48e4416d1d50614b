"""Registered queries with their SQL twins."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import metric_queries, corpus_queries, ingest_queries, feature_queries, model_queries  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
