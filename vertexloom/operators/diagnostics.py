"""How evenly updates spread over lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.scalars import lane


def update_skew(edges: DataFrame, lanes: int, key: str = "dst") -> DataFrame:
    """One row: ``lanes_used``, ``updates``, ``fullest``, ``mean``, ``stddev`` and ``cv``, the coefficient of variation of the
    updates per lane. Lanes without an update count as 0; without any update, ``cv`` is NULL."""
    counts = edges.groupBy(lane(F.col(key), lanes).alias("lane")).agg(F.count(F.lit(1)).alias("n"))
    every = edges.sparkSession.range(lanes).join(counts, F.col("id") == F.col("lane"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return every.agg(
        F.sum((F.col("n") > 0).cast("long")).alias("lanes_used"), F.sum("n").alias("updates"), F.max("n").alias("fullest"), F.avg("n").alias("mean"),
        F.stddev_pop("n").alias("stddev"), (F.stddev_pop("n") / F.nullif(F.avg("n"), F.lit(0.0))).alias("cv"),
    )
