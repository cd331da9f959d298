"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside conditional branches."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
