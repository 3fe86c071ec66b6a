"""Naming intermediate results inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `use`.

    A Column used twice is two copies of its expression, and nested copies
    multiply; inside lambdas Spark does not even share equal ones. A lambda
    variable names the result instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
