"""Edge-list lines as a stream: parsed, counted and stored as they arrive.

The engine's algorithms work on whole graphs; a stream keeps the stored edges and the degrees up to date in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertexloom.operators.strict_load import reason, vertex_value

_FIELD = r"[0-9]+"


def _lines(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.where("NOT startswith(value, '#')").withColumn("reason", reason(F.col("value")))


def read_edge_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """``(src, dst)`` of the conforming lines of the text files that appear in ``folder``."""
    f = F.regexp_extract_all("value", F.lit(_FIELD), F.lit(0))
    return _lines(spark, folder, files_per_batch).where("reason IS NULL").select(vertex_value(f[0]).alias("src"), vertex_value(f[1]).alias("dst"))


def read_rejects(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """``(raw_line, reason)`` of the other lines, comments apart: a stream for a second sink."""
    return _lines(spark, folder, files_per_batch).where("reason IS NOT NULL").select(F.col("value").alias("raw_line"), "reason")


def running_degrees(edges: DataFrame) -> DataFrame:
    """``(id, out_degree, in_degree)``, a streaming aggregate for output modes ``update`` and ``complete``."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def store_edges(edges: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the edges to a Parquet table, each exactly once; runs until the files that are there are read."""
    return edges.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
