"""All registered queries."""

from __future__ import annotations

from worklake.plans import live_queries, log_queries, match_queries, text_queries, view_queries
from worklake.plans.registry import Registry


def build() -> Registry:
    q = Registry()
    for module in (text_queries, log_queries, match_queries, view_queries, live_queries):
        module.register(q)
    return q
