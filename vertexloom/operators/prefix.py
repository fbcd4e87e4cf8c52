"""Running sums within groups of any size, without a group ever being one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, group: list[str], order: str, tie: str, value: str | Column, buckets: int = 1024, name: str = "before") -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that come earlier by ``(order, tie)``.

    ``order`` is an evenly spread LONG (a 64-bit hash). Its leading bits split every group into ``buckets`` parts; the parts'
    totals are summed first, so a window only ever sorts one part of one group: a group with a third of all rows is handled by
    up to ``buckets`` tasks. NULL values count as 0. NULL groups form a group of their own.
    """
    bits = max(1, (max(2, buckets) - 1).bit_length())
    v = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
    rows = df.withColumn("_part", F.shiftright(F.col(order), 64 - bits)).withColumn("_v", v)
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    totals = rows.groupBy(*keys, F.col("_part").alias("_p")).agg(F.sum("_v").alias("_t"))
    earlier = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[f"_g{i}" for i in range(len(group))], "_p", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_start"))
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_part").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, on)
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_part", "_p", "_v", "_start", *[f"_g{i}" for i in range(len(group))])
    )
