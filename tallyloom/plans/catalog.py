"""Imports every module that registers queries."""

from tallyloom.plans import build_queries, content_queries, core_queries, more_queries, stream_queries  # noqa: F401
