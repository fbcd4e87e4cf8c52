"""Vertex programs, run as supersteps of one DataFrame expression each.

State and edges are hash-bucketed by the vertex a superstep joins them on, so the join of the frontier with its edges and the
merge of the combined messages into the state move nothing: **each superstep has one exchange, that of the messages, and they
are combined before it**. Every superstep's state is a table in the shared folder; the number of active vertices is observed
while it is written. A source with more arcs than a part of an even bucket is hot: the arcs of hot sources are spread evenly
over all tasks, and what these sources send is broadcast to them, so that no bucket waits for one vertex.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.arrow import gather, slices
from vertexloom.operators.graph import Graph
from vertexloom.plans.lineage import Workspace
from vertexloom.plans.sizing import parts

#: At least as many buckets as the cluster has cores, and never as many as Spark refuses; beyond that, buckets grow.
EDGES_PER_BUCKET, MOST_BUCKETS = 500_000, 50_000
#: A source is hot from a HUB-th of an even bucket on, so there are at most HUB hot ones for each bucket; one of so few arcs is not.
HUB, COOL = 4, 1000
#: Up to so many active vertices of a graph of more than MANY_BUCKETS buckets are named in the scan of the arcs, which then reads
#: their buckets and pages only: late supersteps of a long search don't scan the graph.
FEW, MANY_BUCKETS = 1000, 64
#: A graph of at most so many edges and vertices is run by a program's kernel in one task: a superstep would take longer to plan
#: than to compute. Larger ones, and all where ``in_task`` is 0, take supersteps.
IN_TASK = 1_000_000


@dataclass(frozen=True)
class VertexProgram:
    """SQL expressions over a vertex's state.

    ``state``: each column's first value, over ``id``, ``out_degree`` and ``in_degree``. ``active``: which vertices start.
    ``message``: what a vertex sends along each edge, over its state, ``weight`` and ``dst``. ``combine``: an aggregate of ``msg``.
    ``accept``: whether the combined ``msg`` (NULL if none came) changes a vertex; ``apply``: the new values of those it changes.
    ``direction``: along the edges (``out``), against them (``in``) or ``both``. ``frontier``: the vertices that changed send
    (``active``), or all do (``all``). A run ends when none is active, or after ``supersteps``. ``kernel`` gives the same output
    columns from the size of the domain and the arcs as arrays, for graphs that fit one task. The hooks run on the driver around
    the supersteps: ``after_iteration`` gets their number and how many vertices are active, and ends the run by False.
    """

    name: str
    state: dict[str, str]
    message: str
    combine: str
    accept: str
    apply: dict[str, str]
    active: str = "true"
    direction: str = "out"
    frontier: str = "active"
    supersteps: int | None = None
    skip_self_loops: bool = True
    needs_weight: bool = False
    needs_in_edges: bool = False
    needs_degrees: bool = False
    output: list[str] = field(default_factory=list)
    kernel: Callable[[int, dict[str, np.ndarray]], dict] | None = None
    before_iteration: Callable[[int], None] | None = None
    after_iteration: Callable[[int, int], bool] | None = None
    finalize: Callable[[int], None] | None = None


def check(graph: Graph, program: VertexProgram) -> None:
    if program.needs_weight and not graph.weighted:
        raise ValueError(f"{program.name} needs a weighted graph")
    if program.needs_in_edges and not graph.with_in_edges:
        raise ValueError(f"{program.name} needs in-edges")


def arcs(graph: Graph, program: VertexProgram) -> DataFrame:
    """``(src, dst[, weight])`` in the direction messages take."""
    g = graph.without_self_loops() if program.skip_self_loops else graph
    if not program.needs_weight and g.weighted:
        g = replace(g, edges=g.edges.select("src", "dst"), weighted=False)
    if program.direction == "both":
        pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), *([F.col("weight")] if g.weighted else []))
        return g.edges.select(F.inline(F.array(pair("src", "dst"), pair("dst", "src"))))
    return (g.transposed() if program.direction == "in" else g).edges


class Run:
    """The supersteps of one program over one set of ``n`` arcs."""

    def __init__(self, arcs_: DataFrame, n: int, program: VertexProgram, edges_per_bucket: int = EDGES_PER_BUCKET, least_buckets: int | None = None):
        spark = arcs_.sparkSession
        least = spark.sparkContext.defaultParallelism if least_buckets is None else least_buckets
        self.program, self.steps, self.buckets = program, 0, max(1, min(MOST_BUCKETS, max(least, parts(n, edges_per_bucket))))
        # Its own session has as many shuffle partitions as there are buckets, so that the state stays in place when messages arrive.
        self.ws = Workspace(spark, program.name, shuffle_partitions=self.buckets)
        self.hubs, self.hot = None, None
        if self.buckets > 1 and n > COOL:
            counts = arcs_.groupBy(F.col("src").alias("hub")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(COOL, n / (HUB * self.buckets)))
            hubs, seen = self.ws.cut_measured(counts.select("hub"), n=F.count(F.lit(1)))
            if seen["n"]:
                self.hubs = F.broadcast(hubs)  # at most HUB * MOST_BUCKETS rows
                self.hot = self.ws.cut(arcs_.join(self.hubs, F.col("src") == F.col("hub"), "left_semi").repartition(self.buckets))
                arcs_ = arcs_.join(self.hubs, F.col("src") == F.col("hub"), "left_anti")
        self.arcs, _ = self.ws.cut_bucketed(arcs_.repartition(self.buckets, "src").sortWithinPartitions("src"), "src", self.buckets)

    def _write(self, state: DataFrame) -> tuple[DataFrame, int]:
        out, seen = self.ws.cut_bucketed(state, "id", self.buckets, n=F.count(F.when(F.col("active"), 1)))
        return out, seen["n"]

    def start(self, vertices: DataFrame) -> tuple[DataFrame, int]:
        p = self.program
        first = vertices.repartition(self.buckets, "id").select("id", *[F.expr(e).alias(c) for c, e in p.state.items()], F.coalesce(F.expr(p.active), F.lit(False)).alias("active"))
        return self._write(first)

    def superstep(self, state: DataFrame, active: int | None = None) -> DataFrame:
        p, arcs_ = self.program, self.arcs
        senders = state.where("active") if p.frontier == "active" else state
        if p.frontier == "active" and active is not None and active <= FEW and self.buckets > MANY_BUCKETS:
            arcs_ = arcs_.where(F.col("src").isin([r["id"] for r in senders.select("id").collect()]))
        message = lambda joined: joined.select("dst", F.expr(p.message).alias("msg"))
        sent = message(arcs_.join(senders.hint("shuffle_hash"), F.col("src") == F.col("id")))
        if self.hot is not None:
            speak = senders.join(self.hubs, F.col("id") == F.col("hub"), "left_semi")
            sent = sent.unionByName(message(self.hot.join(F.broadcast(speak), F.col("src") == F.col("id"))))
        combined = sent.groupBy("dst").agg(F.expr(p.combine).alias("msg"))
        met = state.drop("active").join(combined.hint("shuffle_hash"), F.col("id") == F.col("dst"), "left").withColumn("_ok", F.coalesce(F.expr(p.accept), F.lit(False)))
        new = [F.when(F.col("_ok"), F.expr(p.apply[c])).otherwise(F.col(c)).alias(c) if c in p.apply else F.col(c) for c in p.state]
        return met.select("id", *new, F.col("_ok").alias("active"))

    def fixpoint(self, vertices: DataFrame, most: int | None = None) -> DataFrame:
        """Run to the end; ``most`` supersteps are an error (a cycle of negative weight would never end)."""
        p = self.program
        state, active = self.start(vertices)
        while (active or p.frontier == "all") and (p.supersteps is None or self.steps < p.supersteps):
            if p.before_iteration:
                p.before_iteration(self.steps)
            new, active = self._write(self.superstep(state, active))
            self.ws.drop(state)
            state, self.steps = new, self.steps + 1
            if p.after_iteration and not p.after_iteration(self.steps, active):
                break
            if most is not None and active and self.steps > most:
                raise ValueError(f"{p.name} does not converge: is there a cycle of negative weight?")
        if p.finalize:
            p.finalize(self.steps)
        self.ws.drop(self.arcs, self.hot)
        return state


def fits_task(graph: Graph, in_task: int) -> bool:
    return graph.num_edges is not None and 0 < graph.num_edges <= in_task and graph.max_id < in_task


def in_one_task(graph: Graph, arcs_: DataFrame, kernel: Callable[[int, dict[str, np.ndarray]], dict], schema: str) -> DataFrame:
    n = graph.max_id + 1

    def run_kernel(batches):
        cols = gather(batches) or {"src": np.empty(0, np.int64), "dst": np.empty(0, np.int64), "weight": np.empty(0)}
        yield from slices({"id": np.arange(n)} | kernel(n, cols))

    return arcs_.repartition(1).mapInArrow(run_kernel, schema)


def run(graph: Graph, program: VertexProgram, edges_per_bucket: int = EDGES_PER_BUCKET, in_task: int = IN_TASK, least_buckets: int | None = None) -> DataFrame:
    """``id`` and the program's output columns for every vertex of the dense domain."""
    check(graph, program)
    vertices = graph.degrees() if program.needs_degrees else graph.vertices()
    output = program.output or list(program.state)
    if program.kernel and fits_task(graph, in_task):
        kinds = dict(graph.vertices().selectExpr(*(f"{e} AS {c}" for c, e in program.state.items() if c in output)).dtypes)
        return in_one_task(graph, arcs(graph, program), program.kernel, "id long, " + ", ".join(f"{c} {kinds[c]}" for c in output))
    n = graph.num_edges if graph.num_edges is not None else graph.edges.count()
    state = Run(arcs(graph, program), n * (2 if program.direction == "both" else 1), program, edges_per_bucket, least_buckets).fixpoint(vertices, graph.max_id + 1)
    return state.select("id", *output)


def expand(graph: Graph, frontier: DataFrame) -> DataFrame:
    """``(id, messages)``: one superstep by itself, the number of messages that reach each vertex from ``frontier (id)``, self-loops skipped."""
    start = frontier.select(F.col("id").alias("_id")).distinct()
    sent = graph.without_self_loops().edges.join(start, F.col("src") == F.col("_id"))
    return sent.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("messages"))
