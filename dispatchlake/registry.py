"""Queries over the driver's tables and the SQL to check them."""

from __future__ import annotations

from dispatchlake.plans import catalog_feeds as _feeds  # these register their queries
from dispatchlake.plans import catalog_panels as _panels
from dispatchlake.plans import catalog_streams as _streams
from dispatchlake.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
del _feeds, _panels, _streams
