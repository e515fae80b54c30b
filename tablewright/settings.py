"""Scoped session settings and caller tags."""

from __future__ import annotations

import contextlib
import os
import sys
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

#: Turns caller tags on; the toolkit's entry points then name their caller in Spark's job descriptions.
ANNOTATE = False


@contextlib.contextmanager
def set_local(spark: SparkSession, catalog=None, **options: Any) -> Iterator[None]:
    """Session settings for a while (dots written as __); lists are joined, None is the default. They are restored whatever happens.

    With a catalog given a transaction must be open, as the settings last no longer than that.
    """
    if catalog is not None and not catalog.in_transaction:
        from tablewright.errors import TransactionError

        raise TransactionError("local settings need a transaction")
    before = {}
    try:
        for name, value in options.items():
            key = name.replace("__", ".")
            before[key] = spark.conf.get(key, None)
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value))
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def caller() -> str:
    """process, function, file and line of the nearest frame outside this package and PySpark; empty if there is none."""
    own = os.path.dirname(os.path.abspath(__file__))
    try:
        frame = sys._getframe(1)
        while frame is not None:
            path = frame.f_code.co_filename
            if not os.path.abspath(path).startswith(own) and f"{os.sep}pyspark{os.sep}" not in path and "contextlib" not in path:
                return f"{os.getpid()} {frame.f_code.co_name} {path} {frame.f_lineno}"
            frame = frame.f_back
    except Exception:  # a tag is never worth an error
        return ""
    return ""


@contextlib.contextmanager
def tagged(spark: SparkSession, enabled: bool | None = None) -> Iterator[str]:
    """Jobs inside carry the caller as their description."""
    tag = caller() if (ANNOTATE if enabled is None else enabled) else ""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    try:
        if tag:
            context.setLocalProperty("spark.job.description", tag)
        yield tag
    finally:
        context.setLocalProperty("spark.job.description", before)
