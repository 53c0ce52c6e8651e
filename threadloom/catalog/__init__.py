"""All runnable queries, grouped by subject."""

from . import exchanges, judgements, learning, profiles, similarity, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
