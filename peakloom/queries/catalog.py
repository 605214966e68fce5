"""All queries of the chromatography operators."""

from peakloom.queries import aligned, composed, relational, series, spectral  # noqa: F401
from peakloom.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
