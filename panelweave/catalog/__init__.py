"""Registered queries. Importing this package fills the registry."""

from . import accounts, baskets, modeling, prices, signals  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
