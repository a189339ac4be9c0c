"""Numbers of rows in a global order, without a task that holds all rows of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonegrain.sources import shared


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """rows with their place (from 0) among those of equal `by`, in the order given.

    A range shuffle deals the rows to tasks in order; a place is that in the task, plus the rows of the group in the tasks before
    (one number a task and group). Rows that are equal in by and order are numbered among themselves in any order.
    """
    keys = [*by, *order]
    placed = shared.saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("__task", F.shiftright("__place", 33))
    spans = placed.groupBy("__task", *by).agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    spans = spans.select(F.col("__task").alias("__t"), *(F.col(c).alias(f"__{c}") for c in by), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), by, F.col("__task") == F.col("__t"))
    out = placed.join(spans, same)
    return out.select(*rows.columns, (F.col("__place") - F.col("__first") + F.col("__before")).alias(name))
