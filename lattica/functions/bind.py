"""Names for parts of a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value evaluated once.

    A column that is used several times in an expression is copied to each place, and what is made
    of it copies it again, so nested uses multiply; the variable of a lambda is only read.
    """
    return F.get(F.transform(F.array(value), of), F.lit(0))


def bind_all(values: dict[str, Column], of: Callable[[Column], Column]) -> Column:
    """``of`` a struct of several values, each evaluated once."""
    return bind(F.struct(*[c.alias(n) for n, c in values.items()]), of)
