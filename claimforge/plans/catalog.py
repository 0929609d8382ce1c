"""The registered queries and their independent SQL."""

from __future__ import annotations

from claimforge.plans import matching, more, operations, relational, streams, textual  # noqa: F401  they register themselves
from claimforge.plans.base import ORACLES, QUERIES

FLAGSHIP = "w2_hybrid_rank"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
