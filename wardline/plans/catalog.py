"""All registered queries."""

from wardline.plans import queries_cards, queries_events, queries_text  # noqa: F401
from wardline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
