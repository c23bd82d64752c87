"""All registered queries of the library but the corpus operators'."""

from __future__ import annotations

from .plans import breakdowns, feeds, records, sessions, upkeep

QUERIES = {**breakdowns.Q, **sessions.Q, **upkeep.Q, **feeds.Q, **records.Q}
ORACLES = {**breakdowns.SQL, **sessions.SQL, **upkeep.SQL, **feeds.SQL, **records.SQL}
