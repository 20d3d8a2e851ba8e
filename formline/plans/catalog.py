"""All registered queries."""

from formline.plans import aggregates, cleaning, listings, maintenance, membership, pages, results, sequences, streams  # noqa: F401
from formline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
