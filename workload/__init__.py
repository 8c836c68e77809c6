"""Queries over the given tables, one per capability, with their SQL counterparts."""

from workload import asking, checking, cleaning, exporting, moving, recording
from workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "asking", "checking", "cleaning", "exporting", "moving", "recording"]
