"""Per-key results when a few keys hold most rows: two-stage salted aggregation.

The rows of heavy keys are spread over ``salts`` sub-keys, partial results are computed per sub-key, and the partials, at most
``salts`` for each key and task, are merged by the original key. Every stage combines on the map side before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.vertex_ids import vertex_or_null
from vertexloom.plans.sizing import shuffle_parts

SALTS = 64
#: A key is heavy from this share of all rows on, or from a TASK-th of an even task's rows where there are so many tasks that this is
#: less: there are at most 1000, or TASK for each task of the exchange, heavy keys, whatever the input.
HEAVY_SHARE, TASK = 0.001, 4


def heavy_share(tasks: int) -> float:
    return min(HEAVY_SHARE, 1 / (TASK * max(1, tasks)))


def heavy_keys(rows: DataFrame, keys: list[str], share: float | None = None) -> DataFrame:
    """The distinct ``keys`` that hold at least ``share`` of the rows; at most ``1 / share`` of them."""
    share = heavy_share(shuffle_parts(rows.sparkSession)) if share is None else share
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    return counts.join(F.broadcast(total), F.col("_n") >= F.col("_all") * F.lit(share)).select(*keys)


def neighbour_stats(pairs: DataFrame, keys: list[str], other: str, salts: int = SALTS, share: float | None = None) -> DataFrame:
    """``keys``, ``degree`` (rows), ``distinct_neighbours`` and ``smallest_neighbour`` over the column ``other``.

    A heavy key's salt is drawn from a hash of its neighbour: as spread as a random one, but the same when a lost task runs
    again, and all copies of a pair get the same salt, so that the distinct neighbours of the salts add up. Rows with a NULL
    ``other`` count for ``degree`` only; a key with nothing else has 0 distinct neighbours and a NULL smallest one. NULL keys
    form no group: such rows are left out. An empty input gives an empty result. Further columns are ignored.
    """
    rows = pairs.select(*keys, F.col(other).alias("_other")).dropna(subset=keys)
    hot = heavy_keys(rows, keys, share).withColumn("_hot", F.lit(True))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_other"), F.lit(salts))).otherwise(F.lit(0))
    )
    # One row for each pair, then partial results per salt, then the merge.
    distinct = salted.groupBy(*keys, "_salt", "_other").agg(F.count(F.lit(1)).alias("_n"))
    partial = distinct.groupBy(*keys, "_salt").agg(F.sum("_n").alias("_n"), F.count("_other").alias("_d"), F.min("_other").alias("_s"))
    return partial.groupBy(*keys).agg(
        F.sum("_n").alias("degree"), F.sum("_d").alias("distinct_neighbours"), F.min("_s").alias("smallest_neighbour")
    )


def endpoint_stats(pairs: DataFrame, left: str = "src_vert", right: str = "dest_vert", salts: int = SALTS, share: float | None = None) -> DataFrame:
    """``(endpoint, vert, degree, distinct_neighbours, smallest_neighbour)`` for every vertex of both columns.

    Every row counts, repeated ones too. A row counts for an endpoint if that column holds a vertex id; its other end is a
    neighbour if it is one too, the vertex itself included. Both endpoints share one pass and one shuffle.
    """
    ends = F.array(
        F.struct(F.lit(left).alias("endpoint"), vertex_or_null(left).alias("vert"), vertex_or_null(right).alias("other")),
        F.struct(F.lit(right).alias("endpoint"), vertex_or_null(right).alias("vert"), vertex_or_null(left).alias("other")),
    )
    return neighbour_stats(pairs.select(F.inline(ends)), ["endpoint", "vert"], "other", salts, share)


def heavy_endpoints(stats: DataFrame, one_in: int) -> DataFrame:
    """``(endpoint, vert)`` of the vertices that hold at least one in ``one_in`` of their endpoint's rows."""
    totals = stats.groupBy("endpoint").agg(F.sum("degree").alias("_all"))
    return stats.join(F.broadcast(totals), "endpoint").where(F.col("degree") * one_in >= F.col("_all")).select("endpoint", "vert")
