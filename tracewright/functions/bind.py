"""A value that an expression uses more than once, computed once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)``, where ``value`` is an element that a function is mapped over, and so isn't repeated in the plan."""
    return F.element_at(F.transform(F.array(value), use), 1)
