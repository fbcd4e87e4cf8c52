"""Graphs from text: edge lists and adjacency lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.vertex_ids import MAX_VERTEX
from vertexloom.operators.graph import Graph


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """``(line, f)``: the blank-separated fields of every line that is neither blank nor a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\t\r]", " ")).alias("line"))
    return lines.where("line <> '' AND NOT startswith(line, '#')").select("line", F.split("line", " +").alias("f"))


def _id(text: Column) -> Column:
    value = F.when(text.rlike("^[0-9]{1,18}$"), text.cast("long"))
    return F.when(value <= MAX_VERTEX, value)


def _or_fail(good: Column, line: Column, what: str) -> Column:
    return F.when(good, True).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), line)).cast("boolean"))


# Fixed prime and factor of the drawn weights.
PRIME, FACTOR = 2147483647, 48271


def hashed_weight(seed: int, *key: str) -> Column:
    """A weight in [0, 10) that depends on the columns and the seed only, so a repeated task draws it again."""
    h = F.lit(seed % PRIME).cast("long")
    for c in key:
        for add in (F.col(c).cast("long"), F.lit(1).cast("long")):
            h = F.pmod(h * FACTOR + F.pmod(add, F.lit(PRIME)), F.lit(PRIME))
    return F.pmod(F.pmod(h * FACTOR, F.lit(PRIME)), F.lit(10_000)) / F.lit(1000.0)


def edge_list(spark: SparkSession, path: str, weighted: bool = False, seed: int = 0, on_error: str = "raise") -> Graph:
    """A graph from lines ``src dst [weight]``.

    Lines that start with ``#`` and blank lines are skipped wherever they stand; the lines need no order. Without a third field
    a weighted graph draws weights from the edge and the seed. ``on_error``: ``raise`` for a line that doesn't parse, or
    ``drop`` it (``strict_load`` reports reasons).
    """
    f = F.col("f")
    rows = _fields(spark, path).select("line", F.size(f).alias("n"), _id(f[0]).alias("src"), _id(F.get(f, F.lit(1))).alias("dst"), F.get(f, F.lit(2)).try_cast("double").alias("given"))
    good = F.col("n").between(2, 3) & F.col("src").isNotNull() & F.col("dst").isNotNull() & ((F.col("n") == 2) | F.col("given").isNotNull())
    rows = rows.where(good if on_error == "drop" else _or_fail(good, F.col("line"), "no edge"))
    if not weighted:
        return Graph.from_edges(rows.select("src", "dst"), store=True)
    return Graph.from_edges(rows.select("src", "dst", F.coalesce("given", hashed_weight(seed, "src", "dst")).alias("weight")), weight="weight", store=True)


def adjacency_list(spark: SparkSession, path: str, weighted: bool = False, seed: int = 0) -> Graph:
    """A graph from lines ``src n dst1 ... dstn`` in any order, of any length.

    A line whose ``n`` isn't the number of its destinations, or that holds anything but vertex ids, is an error. A line with
    ``n = 0`` brings no edge, but its vertex widens the id domain.
    """
    f = F.col("f")
    rows = _fields(spark, path).select("line", "f", _id(f[0]).alias("src"), _id(F.get(f, F.lit(1))).alias("n"))
    rows = rows.select("*", F.transform(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))), _id).alias("dsts"))
    good = F.col("src").isNotNull() & F.col("n").isNotNull() & (F.size("dsts") == F.col("n")) & ~F.exists("dsts", lambda d: d.isNull())
    rows = rows.where(_or_fail(good, F.substring("line", 1, 200), "no adjacency row"))
    top = rows.agg(F.max("src")).first()[0]
    edges = rows.select("src", F.posexplode("dsts").alias("pos", "dst"))
    if weighted:
        return Graph.from_edges(edges.select("src", "dst", hashed_weight(seed, "src", "dst", "pos").alias("weight")), weight="weight", max_id=top, store=True)
    return Graph.from_edges(edges.select("src", "dst"), max_id=top, store=True)
