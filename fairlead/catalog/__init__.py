"""All named queries. Importing the modules registers them."""

from fairlead.catalog import contracts, facts, history, matching, outreach, text  # noqa: F401
from fairlead.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
