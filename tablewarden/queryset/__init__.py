"""The registered queries, one module per area of the inventory."""

from tablewarden.queryset.registry import ORACLES, QUERIES
from tablewarden.queryset import alerting, checks, freshness, incidents, kept, promises, rules, scans, shape, streams, upkeep, volume  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
