"""The graph algorithms, as vertex programs and loops of them. Each gives a row for every id of the dense domain."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import local_graph as local
from vertexloom.operators import engine
from vertexloom.operators.engine import VertexProgram
from vertexloom.operators.graph import Graph
from vertexloom.plans.lineage import Workspace

# Fixed values of the algorithms.
DAMPING, PER_EDGE, EPSILON = 0.85, 0.15, 1e-3


def _known(graph: Graph, root: int, what: str) -> None:
    if not 0 <= root <= graph.max_id:
        raise ValueError(f"the {what} {root} is no vertex: ids go from 0 to {graph.max_id}")


def _leaves(graph: Graph, root: int, what: str, usable: str = "true") -> None:
    """The supersteps notice a root without a way out by themselves; before a kernel runs, it is looked up."""
    if graph.edges.where((F.col("src") == root) & (F.col("dst") != root)).where(usable).isEmpty():
        raise ValueError(f"the {what} {root} reaches no other vertex")


def _or_null(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=values < 0)


def _first_hop(what: str, root: int):
    def after(step: int, active: int) -> bool:
        if step == 1 and not active:
            raise ValueError(f"the {what} {root} reaches no other vertex")
        return True

    return after


def bfs_program(root: int) -> VertexProgram:
    return VertexProgram(
        "bfs", {"level": f"CASE WHEN id = {root} THEN 0L END"}, "level + 1", "min(msg)", "msg < level OR (level IS NULL AND msg IS NOT NULL)", {"level": "msg"},
        active=f"id = {root}", after_iteration=_first_hop("root", root), kernel=lambda n, c: {"level": _or_null(local.levels(n, c["src"], c["dst"], root))},
    )


def bfs(graph: Graph, root: int = 0, in_task: int = engine.IN_TASK) -> DataFrame:
    """``(id, level)``: hops from the root, NULL if it doesn't reach the vertex. Self-loops don't count; a root that is no vertex
    or reaches nothing is an error."""
    _known(graph, root, "root")
    if engine.fits_task(graph, in_task):
        _leaves(graph, root, "root")
    return engine.run(graph, bfs_program(root), in_task=in_task)


def sssp_program(source: int) -> VertexProgram:
    def kernel(n: int, c: dict[str, np.ndarray]) -> dict:
        value, predecessor = local.distances(n, c["src"], c["dst"], c["weight"], source, EPSILON)
        return {"predecessor": _or_null(predecessor), "value": value}

    return VertexProgram(
        "sssp", {"predecessor": "CAST(NULL AS LONG)", "value": f"CASE WHEN id = {source} THEN 0D ELSE double('Infinity') END"},
        "CASE WHEN weight IS NOT NULL THEN struct(value + weight AS value, id AS predecessor) END", "min(msg)", f"msg.value < value AND NOT coalesce(abs(msg.value - value) < {EPSILON}D, false)",
        {"predecessor": "msg.predecessor", "value": "msg.value"}, active=f"id = {source}", needs_weight=True, after_iteration=_first_hop("source", source), kernel=kernel,
    )


def sssp(graph: Graph, source: int = 0, in_task: int = engine.IN_TASK) -> DataFrame:
    """``(id, predecessor, value)``: the distance from the source, Infinity where it doesn't reach, and the vertex it was reached from.

    An improvement of less than 0.001 is none. Of equal distances that arrive in one superstep, the smallest predecessor counts;
    an equal one that arrives later is not taken. An edge whose weight is NULL or NaN carries no message. A cycle of negative
    weight is an error.
    """
    _known(graph, source, "source")
    program = sssp_program(source)
    engine.check(graph, program)
    if engine.fits_task(graph, in_task):
        _leaves(graph, source, "source", "weight < double('Infinity')")
    return engine.run(graph, program, in_task=in_task)


def pagerank_program(iterations: int) -> VertexProgram:
    return VertexProgram(
        "pagerank", {"rank": "1D", "out_degree": "out_degree"}, f"{DAMPING}D * (rank / out_degree) + {PER_EDGE}D", "sum(msg)", "msg IS NOT NULL", {"rank": "rank + msg"},
        frontier="all", supersteps=iterations, skip_self_loops=False, needs_degrees=True, output=["rank"],
        kernel=lambda n, c: {"rank": local.ranks(n, c["src"], c["dst"], iterations, DAMPING, PER_EDGE)},
    )


def pagerank(graph: Graph, iterations: int = 10, in_task: int = engine.IN_TASK) -> DataFrame:
    """``(id, rank)`` after so many iterations of ``rank += sum over in-edges of 0.85 * rank(src) / out_degree(src) + 0.15``.

    Ranks start at 1 and accumulate: nothing is reset or normalised, and self-loops and repeated edges count.
    """
    if iterations < 1:
        raise ValueError("pagerank needs at least one iteration")
    return engine.run(graph, pagerank_program(iterations), in_task=in_task)


def spmv(graph: Graph, x: DataFrame | None = None) -> DataFrame:
    """``(id, origin_value, spmv_value)``: the transposed weight matrix times ``x (id, value)``, whose missing values are 1.

    One pass, so it is one aggregation (after one join, if ``x`` is given) and no superstep. Self-loops and repeated edges count.
    """
    if not graph.weighted:
        raise ValueError("spmv needs a weighted graph")
    vertices = graph.vertices().withColumn("origin_value", F.lit(1.0))
    sent = graph.edges.select("dst", F.col("weight").alias("m"))
    if x is not None:
        given = x.select(F.col("id").alias("_x"), F.col("value").cast("double").alias("_v"))
        vertices = graph.vertices().join(given, F.col("id") == F.col("_x"), "left").select("id", F.coalesce("_v", F.lit(1.0)).alias("origin_value"))
        sent = graph.edges.join(given, F.col("src") == F.col("_x"), "left").select("dst", (F.col("weight") * F.coalesce("_v", F.lit(1.0))).alias("m"))
    sums = sent.groupBy("dst").agg(F.sum("m").alias("_s"))
    return vertices.join(sums, F.col("id") == F.col("dst"), "left").select("id", "origin_value", F.coalesce("_s", F.lit(0.0)).alias("spmv_value"))


def wcc_program() -> VertexProgram:
    def kernel(n: int, c: dict[str, np.ndarray]) -> dict:
        root = np.arange(n)
        ids, low = local.stars(c["src"], c["dst"])
        root[ids] = low
        return {"component_root": root}

    return VertexProgram(
        "wcc", {"component_root": "id"}, "component_root", "min(msg)", "msg < component_root", {"component_root": "msg"}, direction="both", needs_in_edges=True, kernel=kernel
    )


def wcc(graph: Graph, in_task: int = engine.IN_TASK) -> DataFrame:
    """``(id, component_root)``: the smallest id of the weak component; a vertex without edges is its own."""
    return engine.run(graph, wcc_program(), in_task=in_task)


def component_count(components: DataFrame) -> DataFrame:
    """``(components)``: how many vertices are their own root."""
    return components.where("id = component_root").agg(F.count(F.lit(1)).alias("components"))


def _colour_program() -> VertexProgram:
    return VertexProgram("scc_forward", {"colour": "id"}, "colour", "min(msg)", "msg < colour", {"colour": "msg"})


def _reach_program() -> VertexProgram:
    """Against the edges within a colour, from the vertex the colour is named after."""
    return VertexProgram("scc_backward", {"colour": "colour", "found": "id = colour"}, "true", "max(msg)", "msg AND NOT found", {"found": "true"}, active="id = colour")


def _trim(ws: Workspace, edges: DataFrame, n: int, least: float = 0.1) -> tuple[DataFrame, int]:
    """Drop edges at vertices that nothing enters or nothing leaves: each is a component of its own. Repeated while it pays."""
    while n:
        into, from_ = edges.select(F.col("dst").alias("v")).distinct(), edges.select(F.col("src").alias("v")).distinct()
        kept, seen = ws.cut_measured(edges.join(into, F.col("src") == into["v"], "left_semi").join(from_, F.col("dst") == from_["v"], "left_semi"), n=F.count(F.lit(1)))
        ws.drop(edges)
        edges, before, n = kept, n, seen["n"]
        if before - n < least * before:
            break
    return edges, n


def scc(graph: Graph, edges_per_bucket: int = engine.EDGES_PER_BUCKET, in_task: int = engine.IN_TASK) -> DataFrame:
    """``(id, component_root)``: the smallest id of the strong component.

    Forward, each vertex takes the smallest id that reaches it as its colour; backward, the vertex a colour is named after finds
    its component among the vertices of that colour. What is found, edges between colours, and vertices without edges in or
    out leave the graph; the rest starts again with its own ids.
    """
    if not graph.with_in_edges:
        raise ValueError("scc needs in-edges")
    if engine.fits_task(graph, in_task):
        kernel = lambda n, c: {"component_root": local.strong_components(n, c["src"], c["dst"])}
        return engine.in_one_task(graph, graph.edges.select("src", "dst"), kernel, "id long, component_root long")
    ws = Workspace(graph.spark, "scc")
    edges, seen = ws.cut_measured(graph.without_self_loops().edges.select("src", "dst").distinct(), n=F.count(F.lit(1)))
    n, found = seen["n"], []
    while True:
        edges, n = _trim(ws, edges, n)
        if not n:
            break
        vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        coloured = engine.Run(edges, n, _colour_program(), edges_per_bucket).fixpoint(vertices).select("id", "colour")
        a, b = coloured.select(F.col("id").alias("src"), F.col("colour").alias("_a")), coloured.select(F.col("id").alias("dst"), F.col("colour").alias("_b"))
        within = ws.cut(edges.join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst"))
        back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reached = engine.Run(back, n, _reach_program(), edges_per_bucket).fixpoint(coloured)
        found.append(reached.where("found").select("id", F.col("colour").alias("component_root")))
        done = reached.where("found").select(F.col("id").alias("v"))
        left, seen = ws.cut_measured(within.join(done, F.col("src") == done["v"], "left_anti").join(done, F.col("dst") == done["v"], "left_anti"), n=F.count(F.lit(1)))
        edges, n = left, seen["n"]
    labels = graph.vertices()
    if not found:
        return labels.select("id", F.col("id").alias("component_root"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return labels.join(every.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component_root", "id").alias("component_root"))


def first_rows(result: DataFrame, n: int = 100) -> DataFrame:
    """The rows of the ``n`` smallest ids, as the programs log them at their end."""
    return result.orderBy("id").limit(n)


__all__ = ["bfs", "component_count", "first_rows", "pagerank", "scc", "spmv", "sssp", "wcc"]
