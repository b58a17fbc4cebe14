"""Helpers for expressions with lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once.

    What a lambda refers to from outside is evaluated again for each element,
    unless it is a column or a variable; this makes it a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def zipped(pieces: Column, between: Column) -> Column:
    """Pieces and what stands between them as one text."""
    return F.concat_ws("", F.zip_with(pieces, between, lambda p, b: F.concat(F.coalesce(p, F.lit("")), F.coalesce(b, F.lit("")))))
