"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value), with value computed once, also where lambdas read it: a projection that reads it often would be merged and repeat it."""
    return F.element_at(F.transform(F.array(value), then), 1)
