"""starledger: incident-style star-schema analytics on Spark DataFrames.

A star here is three tables: *subjects* (people or other units), a weighted
*catalog* of rule types, and a dated *fact* table that points at both.  The
library computes yearly KPIs, monthly trends, top-N rankings, per-subject
severity roll-ups with risk bands, filtered listings, validated bulk intake,
and snapshot-to-snapshot table maintenance, all as lazy DataFrame plans.
"""

from starledger.spec import StarSpec, DEFAULT_SPEC  # noqa: F401
from starledger.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["StarSpec", "DEFAULT_SPEC", "get_session", "checkpoint_dir"]
