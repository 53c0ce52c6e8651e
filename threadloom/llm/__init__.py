"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage. `QUERIES` and `ORACLES`
hold what the driver runs.
"""

from . import byte_bpe, collocations, decontaminate, exact_dedup, html_text, jaccard_join, periodic_runs, pitman_yor, quality, simhash, token_counts, toxicity, warc  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
