"""Ordered CASE expressions from lists, and names for intermediate values."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def cases(branches: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """First branch whose condition holds, else `otherwise`."""
    expr = F
    for condition, result in branches:
        expr = expr.when(condition, result)
    return F.lit(otherwise) if expr is F else expr.otherwise(otherwise)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
