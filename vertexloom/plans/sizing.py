"""Numbers of partitions that follow the data, never the machine the tests run on."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession


def parts(rows: int, rows_per_part: int) -> int:
    """So many partitions that each holds about ``rows_per_part`` evenly hashed rows."""
    return max(1, math.ceil(rows / rows_per_part))


def shuffle_parts(spark: SparkSession) -> int:
    """The session's shuffle width, for exchanges whose input has no count yet."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
