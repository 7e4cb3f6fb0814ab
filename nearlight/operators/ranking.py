"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearlight.session import cut


def ranked(rows: DataFrame, by: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 1, by ``order`` ascending) and ``total`` (rows) of each group ``by``.

    No task holds a group: rows are dealt by ranges of group and order, counted in each range, and
    ranked there on top of the counts of the ranges before it. ``order`` should end in a key, else
    equal rows share a range and take any order. Null groups are groups. With ``weight`` a row stands for
    so many: ``rank`` is that of its last."""
    each = F.sum(weight) if weight else F.count("*")
    keys = [*by, *order]
    dealt = cut(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranked")
    whole = [f"_by{i}" for i in range(len(by))]
    count = dealt.groupBy("_part", *[F.col(b).alias(w) for b, w in zip(by, whole)]).agg(each.alias("_n"))
    before = Window.partitionBy(*whole).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    count = count.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("total", F.sum("_n").over(Window.partitionBy(*whole)))
    same: Column = F.col("_part") == F.col("_at")
    for b, w in zip(by, whole):
        same &= F.col(b).eqNullSafe(F.col(w))
    joined = dealt.join(count.withColumnRenamed("_part", "_at"), same)
    at = Window.partitionBy("_part", *by).orderBy(*order)
    here = F.sum(weight).over(at.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(at)
    return joined.withColumn("rank", here + F.col("_before")).drop("_part", "_at", "_n", "_before", *whole)
