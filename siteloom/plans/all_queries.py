"""Imports every module that registers queries."""

from siteloom.plans import filter_queries, frame_queries, join_queries, rewrite_queries, stats_queries  # noqa: F401
