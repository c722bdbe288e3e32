"""One runnable query per operator, each with the SQL it must agree with."""

from penprint.catalog import cleaning, curation, featuring, jobs, reports, selection, splits, statistics  # noqa: F401
from penprint.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
