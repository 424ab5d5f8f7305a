"""Spark-native opportunity analytics: page snapshots in, ranked and versioned records out."""

from fairlead.session import build_session, configure

__all__ = ["build_session", "configure"]
