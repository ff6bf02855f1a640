"""Running totals over a long order without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive positions that one task sums in a row.
RANGE = 4096


def running_total(df: DataFrame, keys: list[str], at: str, value: Column, name: str, size: int = RANGE) -> DataFrame:
    """df with the sum of value over rows of the same keys with a smaller or equal `at` (a long, each once).

    Two levels: sums of ranges of `at` are totalled over ranges, then added to totals inside a range.
    """
    parts = df.withColumn("_range", F.floor(F.col(at) / size)).withColumn("_value", value)
    sums = parts.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("_inside", F.sum("_value").over(inside)).join(offsets, [*keys, "_range"])
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_value", "_inside", "_before")
