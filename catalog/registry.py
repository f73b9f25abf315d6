"""All registered queries."""

from catalog import changes, clinical, dictionary, joins, observations, reports, sources_filters, streams  # noqa: F401
from catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
