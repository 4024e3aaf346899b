"""Array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, also where it is used for each element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
