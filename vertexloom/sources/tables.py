"""Graphs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.functions.vertex_ids import is_vertex
from vertexloom.operators.graph import Graph
from vertexloom.plans.lineage import Workspace


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_graph(spark: SparkSession, folder: str, least_quantity: int = 46) -> Graph:
    """Parts that follow each other in an order, for lines of at least this quantity; the follower's quantity is the weight."""
    lines = _table(spark, folder, "lineitem")
    a = lines.where(F.col("l_quantity") >= least_quantity).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    b = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"))
    return Graph.from_edges(a.join(b, ["l_orderkey", "l_linenumber"]), weight="weight", store=True)


def trade_graph(spark: SparkSession, folder: str, quantity: int | None = 50) -> Graph:
    """Nations of customers to nations of suppliers, one edge for each line of this quantity; None: for every line."""
    wanted = F.lit(True) if quantity is None else F.col("l_quantity") == quantity
    lines = _table(spark, folder, "lineitem").where(wanted).select("l_orderkey", "l_suppkey", "l_quantity")
    orders = _table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = _table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    suppliers = _table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    edges = lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey")
    return Graph.from_edges(edges, weight="l_quantity", store=True)


def weighted_slot_graph(spark: SparkSession, folder: str) -> Graph:
    """``slot_graph`` with its weights. One that is NULL, NaN or negative is none (NULL): its edge counts in degrees and offsets,
    carries no message in SSSP and adds nothing to SpMV."""
    weight = F.when((F.col("weight") >= 0) & ~F.isnan("weight"), F.col("weight"))
    slots = _table(spark, folder, "edge").where(is_vertex("src") & is_vertex("dest_vert")).groupBy("slot", "src", "dest_vert").agg(F.max(weight).alias("weight"))
    return Graph.from_edges(slots, dst="dest_vert", weight="weight", store=True)


def slot_graph(spark: SparkSession, folder: str) -> Graph:
    """The table of out-edge slots: a slot that was written twice is one edge, slots without a destination are none."""
    slots = _table(spark, folder, "edge").where(is_vertex("src") & is_vertex("dest_vert")).select("slot", "src", "dest_vert")
    return Graph.from_edges(slots.groupBy("slot", "src", "dest_vert").agg(F.lit(1)), dst="dest_vert", store=True)


def user_graph(spark: SparkSession, folder: str) -> Graph:
    """From the user of an error to that of the next event, in order of time and id; unweighted.

    The order is global, but no task holds it whole: ranges of it are numbered by a window each, and a range's last event finds its
    follower among the ranges' first ones.
    """
    ws = Workspace(spark, "events")
    events = _table(spark, folder, "events").select("ts", "event_id", "user_id", "event_type")
    ranged = ws.cut(events.repartitionByRange("ts", "event_id").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("ts", "event_id")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("f"))
    # A row for each range.
    follows = firsts.select((F.lag("part").over(Window.orderBy("part"))).alias("part"), F.col("f.user_id").alias("_next"))
    rows = ranged.withColumn("dst", F.lead("user_id").over(inside)).withColumn("_last", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("ts"), F.desc("event_id"))) == 1)
    met = rows.join(F.broadcast(follows), "part", "left").select("event_type", F.col("user_id").alias("src"), F.when(F.col("_last"), F.col("_next")).otherwise(F.col("dst")).alias("dst"))
    return Graph.from_edges(met.where("event_type = 'error'"), store=True)


def busiest_source(graph: Graph) -> int:
    """The vertex of largest out-degree, the smallest id among equals."""
    top = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").first()
    if top is None:
        raise ValueError("the graph has no edges")
    return top["src"]
