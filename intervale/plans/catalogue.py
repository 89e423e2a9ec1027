"""All queries of the library."""

from intervale.plans import events, longsignals, models, nulls, relations, segments, signals, smaller, streams, subspaces, units
from intervale.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "events", "longsignals", "models", "nulls", "relations", "segments", "signals", "smaller", "streams", "subspaces", "units"]
