"""Directed multigraphs over a dense id domain: every id from 0 to the largest one is a vertex, with edges or without."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.functions.vertex_ids import is_vertex
from vertexloom.plans.lineage import Workspace

#: Pieces of the id domain for running sums over it.
PIECES = 4096


@dataclass(frozen=True)
class Graph:
    """``edges (src, dst[, weight])``, repeated edges and self-loops kept; ``max_id`` is -1 for a graph without vertices.

    ``by_dst (dst, src)``, if there is one, holds the same edges in order of their destination: what looks for in-edges reads it.
    """

    edges: DataFrame
    max_id: int
    weighted: bool
    with_in_edges: bool = True
    num_edges: int | None = None
    by_dst: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def from_edges(cls, edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, max_id: int | None = None, store: bool = False) -> Graph:
        """Rows whose ends aren't both vertex ids are no edges. They are counted, and the largest id found, in one pass; with
        ``store`` that pass also writes them to the shared folder, so that edges that are joined or parsed are made only once."""
        cols = [F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")]
        if weight:
            cols.append(F.col(weight).cast("double").alias("weight"))
        edges = edges.where(is_vertex(src) & is_vertex(dst)).select(*cols)
        measures = {"top": F.max(F.greatest("src", "dst")), "n": F.count(F.lit(1))}
        if store:
            edges, seen = Workspace(edges.sparkSession, "edges").cut_measured(edges, **measures)
        else:
            seen = edges.agg(*(c.alias(k) for k, c in measures.items())).first()
        top = -1 if seen["top"] is None else seen["top"]
        return cls(edges, top if max_id is None else max(max_id, top), weight is not None, num_edges=seen["n"])

    def vertices(self) -> DataFrame:
        """``(id)``: the dense domain."""
        return self.spark.range(self.max_id + 1)

    def without_self_loops(self) -> Graph:
        return replace(self, edges=self.edges.where("src <> dst"), by_dst=None if self.by_dst is None else self.by_dst.where("src <> dst"))

    def transposed(self) -> Graph:
        """Every edge turned round; weights stay with their edges."""
        rest = ["weight"] if self.weighted else []
        rows = self.edges if rest or self.by_dst is None else self.by_dst
        return replace(self, edges=rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), by_dst=None)

    def _degrees(self, key: str, name: str) -> DataFrame:
        rows = self.by_dst if key == "dst" and self.by_dst is not None else self.edges
        n = rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        return self.vertices().join(n, F.col("id") == F.col("_k"), "left").select("id", F.coalesce("_n", F.lit(0)).alias(name))

    def out_degrees(self) -> DataFrame:
        """``(id, out_degree)``, self-loops and repeated edges included, for every vertex."""
        return self._degrees("src", "out_degree")

    def in_degrees(self) -> DataFrame:
        """``(id, in_degree)`` for every vertex."""
        return self._degrees("dst", "in_degree")

    def degrees(self) -> DataFrame:
        """``(id, out_degree, in_degree)`` for every vertex, by one aggregation over both ends."""
        ends = self.edges.select(F.inline(F.array(
            F.struct(F.col("src").alias("_k"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("_k"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )))
        n = ends.groupBy("_k").agg(F.sum("o").alias("_o"), F.sum("i").alias("_i"))
        zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name)
        return self.vertices().join(n, F.col("id") == F.col("_k"), "left").select("id", zero("_o", "out_degree"), zero("_i", "in_degree"))

    def describe(self) -> DataFrame:
        """One row: ``min_vertex_id, max_vertex_id, num_of_edges, max_out_edges, edge_type, with_in_edge``.

        The ids are the smallest and largest that occur in an edge; NULL in a graph without edges.
        """
        per_src = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("lo"), F.max("dst").alias("hi"))
        return per_src.agg(
            F.min(F.least("src", "lo")).alias("min_vertex_id"), F.max(F.greatest("src", "hi")).alias("max_vertex_id"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("num_of_edges"), F.coalesce(F.max("n"), F.lit(0)).alias("max_out_edges"),
            F.lit(1 if self.weighted else 2).alias("edge_type"), F.lit(1 if self.with_in_edges else 0).alias("with_in_edge"),
        )

    def _index(self, key: str) -> DataFrame:
        """1-based ordinal of the first edge of every vertex in key order; 0 for a vertex without edges.

        The running sum works in pieces of the id domain: totals of the pieces first, then each piece for itself.
        """
        width = max(1, -(-(self.max_id + 1) // PIECES))
        n = self._degrees(key, "n").withColumn("piece", F.floor(F.col("id") / width))
        order = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # over at most PIECES rows
        starts = n.groupBy("piece").agg(F.sum("n").alias("t")).select(F.col("piece").alias("_p"), F.coalesce(F.sum("t").over(order), F.lit(0)).alias("_s"))
        inside = Window.partitionBy("piece").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        at = F.col("_s") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + 1
        return n.join(F.broadcast(starts), F.col("piece") == F.col("_p")).select("id", F.when(F.col("n") > 0, at).otherwise(F.lit(0)).cast("long").alias("offset"))

    def csr_index(self) -> DataFrame:
        """``(id, offset)`` into the edges in order of their source."""
        return self._index("src")

    def csc_index(self) -> DataFrame:
        """``(id, offset)`` into the edges in order of their destination."""
        return self._index("dst")

    def out_edges(self, ids: DataFrame) -> DataFrame:
        """The edges that leave the vertices ``ids (id)``."""
        return self.edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")

    def in_edges(self, ids: DataFrame) -> DataFrame:
        """The edges that enter the vertices ``ids (id)``; of a graph stored with in-edges, only files and pages that may hold them
        are read where Spark knows the ids, and weights aren't."""
        return (self.edges if self.by_dst is None else self.by_dst).join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
