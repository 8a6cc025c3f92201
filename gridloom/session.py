"""The session that operators without a DataFrame argument use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .errors import NoSession

_session: SparkSession | None = None


def set_session(spark: SparkSession | None) -> None:
    """Names the session to use; None goes back to the active one."""
    global _session
    _session = spark


def get_session(spark: SparkSession | None = None) -> SparkSession:
    found = spark or _session or SparkSession.getActiveSession()
    if found is None:
        raise NoSession("pass a SparkSession, or call set_session first")
    return found
