"""All registered queries."""

from workload import particles, process, selection, tracking, windows  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
