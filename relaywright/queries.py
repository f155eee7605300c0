"""Imports every module that registers queries."""

from relaywright.plans import aggregates, filters, joins, scalars, stateful, windows  # noqa: F401
from relaywright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
