"""Which vectors count as such."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    c = f"`{column}`"
    return F.expr(f"{c} is not null and size({c}) > 0 and not exists({c}, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
