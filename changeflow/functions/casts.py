"""Text -> typed casts with a chosen failure mode.

``on_error``: ``"null"`` (``try_cast``: a bad value becomes NULL),
``"fail"`` (ANSI ``cast``: the job fails, as a hard SQL CAST does) or
``"quarantine"`` (``try_cast``, and :func:`cast_errors` reports the value so the
row can be routed to a rejects table).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ON_ERROR = ("null", "fail", "quarantine")


def cast_leaf(c: Column, dtype: str, on_error: str = "null") -> Column:
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    if dtype == "string":
        return c
    if on_error == "fail":
        return c.cast(dtype)
    return c.try_cast(dtype)


def cast_errors(pairs) -> Column:
    """Names of the leaves whose text did not cast: ``pairs`` is an iterable of
    ``(name, text_column, dtype)``. Empty array = clean row."""
    checks = [
        F.when(txt.isNotNull() & txt.try_cast(dtype).isNull(), F.lit(name))
        for name, txt, dtype in pairs if dtype != "string"
    ]
    if not checks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*checks), lambda x: x.isNotNull())
