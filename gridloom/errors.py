"""Errors that callers can tell apart."""


class GridloomError(Exception):
    """Any error of this package."""


class InvalidParameters(GridloomError, ValueError):
    """Arguments that make no operation."""


class NoSession(GridloomError, RuntimeError):
    """No SparkSession was given and none is active."""
