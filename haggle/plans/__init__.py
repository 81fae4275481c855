"""All registered queries, by importing the modules that register them."""

from haggle.plans import cleaning, learning, ledger, market, payments, restriction, scoring  # noqa: F401
from haggle.plans.registry import QUERIES

__all__ = ["QUERIES"]
