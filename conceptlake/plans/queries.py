"""Every registered query: a function of (spark, sf_dir), and its SQL twin where SQL can express it."""

from conceptlake.plans import deliveries, graphs, histories, listings, searches
from conceptlake.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "deliveries", "graphs", "histories", "listings", "searches"]
