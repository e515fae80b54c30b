"""Errors of the toolkit and helpers for Spark's own."""

from __future__ import annotations


class TablewrightError(Exception):
    """Base of all errors here."""


class SuspiciousOperation(TablewrightError):
    """Arguments that cannot mean what they say: unknown names, batches of unequal rows."""


class ImproperlyConfigured(TablewrightError):
    """A declaration (view, partitioned table) that does not hold together."""


class IntegrityError(TablewrightError):
    """Rows that break a unique, required, check or foreign key."""


class CardinalityViolation(IntegrityError):
    """One batch that would update a row twice."""


class NotPopulatedError(TablewrightError):
    """A materialized view that was never filled."""

    sqlstate = "55000"


class PartitioningError(TablewrightError):
    """A partition configuration or plan that cannot be carried out, or a row without a partition."""


class TransactionError(TablewrightError):
    """An operation that needs a transaction, or must not run in one."""


class StaleStateError(TransactionError):
    """Another writer changed a table since this transaction read it; nothing was written, and the transaction may run again."""


def spark_error(error: BaseException) -> BaseException | None:
    """The Spark error in a chain of causes."""
    from pyspark.errors import PySparkException

    seen = set()
    while error is not None and id(error) not in seen:
        if isinstance(error, PySparkException):
            return error
        seen.add(id(error))
        error = error.__cause__ or error.__context__
    return None


def sqlstate(error: BaseException) -> str | None:
    """The SQLSTATE of an error here or in Spark."""
    own = getattr(error, "sqlstate", None)
    if isinstance(own, str):
        return own
    found = spark_error(error)
    return found.getSqlState() if found is not None and hasattr(found, "getSqlState") else None
