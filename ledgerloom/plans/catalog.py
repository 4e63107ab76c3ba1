"""All named queries."""

from ledgerloom.plans import judging, linking, pairing_plans, reconciling, sources_plans, surface  # noqa: F401
from ledgerloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
