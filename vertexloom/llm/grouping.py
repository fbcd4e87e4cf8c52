"""Consolidating pairwise matches into groups: one identifier for all records that are linked directly or indirectly.

1. Each input partition is reduced to the spanning stars of its own components before anything is shuffled: repeated pairs
   and the rows of hot vertices shrink to one row for each vertex and task, which also counts the rows the vertex occurs in.
2. The giant component is peeled: a breadth-first search by frontier joins from the vertex of highest degree in the input, whose
   vertices are then removed by an anti-join. The search ends once a level gains too few vertices for the edges it scans.
3. The small components that remain are labelled by minimum propagation: every vertex takes the smallest id around it, the
   edges are rewritten to the labels, and only vertices that are some vertex's label stay in the next round's graph. A chain
   of any length therefore takes logarithmically many, ever smaller rounds. Labels are expanded backwards at the end.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.arrow import slices, whole_partition
from vertexloom.functions.local_graph import stars
from vertexloom.functions.vertex_ids import NO_VERTEX, vertex_or_null
from vertexloom.plans.lineage import Workspace

#: Rows that one contraction in a task holds at once.
CHUNK = 1 << 20
#: After WARM levels, the breadth-first search ends with one that gains less than a vertex for GAIN edges scanned: a search of L
#: levels has found L / GAIN of the graph, and there are never more than WARM + GAIN levels.
WARM, GAIN = 4, 100
#: Rounds of the propagation that are always made; after them, as few edges as LAST are labelled in one task, since the last rounds
#: would each move a handful.
LEAST_ROUNDS, LAST = 1, 20_000


def _contract(batches):
    held, rows = [], 0

    def emit():
        a = np.concatenate([h[0] for h in held])
        b = np.concatenate([h[1] for h in held])
        v, low = stars(a, b)
        n = np.bincount(np.searchsorted(v, a), minlength=len(v)) + np.bincount(np.searchsorted(v, b), minlength=len(v))
        return slices({"a": low, "b": v, "n": n})

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= CHUNK:
            yield from emit()
            held, rows = [], 0
    if rows:
        yield from emit()


def _labels(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    v, low = stars(cols["a"], cols["b"])
    return {"v": v, "label": low}


CONTRACTED = "a long, b long, n long"


def _ends(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with a vertex at one end only become loops: they bring their vertex, but no link."""
    x, y = vertex_or_null(a), vertex_or_null(b)
    return links.select(F.coalesce(x, y).alias("a"), F.coalesce(y, x).alias("b")).where("a IS NOT NULL")


def _peel(ws: Workspace, edges: DataFrame, n_edges: int, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The giant component's vertices as far as the search from ``top (v)`` goes, and the edges that are left.

    The vertices of the last level, if there are any, are linked to the smallest vertex found, which stands for all of them: what
    hangs on them is left to the propagation.
    """
    found, size = [ws.cut(top)], 1
    while True:
        frontier, seen = found[-1], reduce(DataFrame.unionByName, found)
        # The edges are only shuffled for a frontier that is too large for Spark to broadcast by its measured size.
        out = edges.join(frontier, edges["a"] == frontier["v"], "left_semi").select(F.col("b").alias("v"))
        back = edges.join(frontier, edges["b"] == frontier["v"], "left_semi").select(F.col("a").alias("v"))
        fresh, n = ws.cut_measured(out.unionByName(back).distinct().join(seen, "v", "left_anti"), n=F.count(F.lit(1)))
        if not n["n"] or (len(found) > WARM and n["n"] * GAIN < n_edges):
            break
        found.append(fresh)
        size += n["n"]
    giant = ws.cut(seen)
    rest = edges.join(giant, edges["a"] == giant["v"], "left_anti").join(giant, edges["b"] == giant["v"], "left_anti")
    if n["n"]:
        rep = giant.agg(F.min("v").alias("a"))
        rest = rest.unionByName(fresh.join(F.broadcast(rep)).select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b")))
    return giant, rest


def _propagate(ws: Workspace, edges: DataFrame, n: int) -> DataFrame:
    """``(v, label)``: one label for each component of the edges' vertices.

    The minimum is taken by a hash that differs each round: ids in order along a chain would let it lose one vertex a round.
    """
    rounds = []
    while n > LAST or (n and len(rounds) < LEAST_ROUNDS):
        r = len(rounds)
        # Hash and id in one LONG, so that the minimum stays a hash aggregate; ids have 32 bits.
        rank = lambda c: F.shiftleft(F.hash(F.col(c), F.lit(r)).cast("long"), 32).bitwiseOR(F.col(c))  # noqa: B023, E731
        pair = lambda v, u: F.struct(F.col(v).alias("v"), rank(u).alias("u"))  # noqa: B023, E731
        both = edges.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
        low = ws.cut(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least(rank("v"), "u").bitwiseAND(NO_VERTEX).alias("low")))
        rounds.append(low)
        at_a, at_b = low.select(F.col("v").alias("a"), F.col("low").alias("_a")), low.select(F.col("v").alias("b"), F.col("low").alias("_b"))
        moved = edges.join(at_a, "a").join(at_b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        fresh, seen = ws.cut_measured(moved.distinct(), n=F.count(F.lit(1)))
        ws.drop(edges)
        edges, n = fresh, seen["n"]
    final = edges.repartition(1).mapInArrow(whole_partition(_labels), "v long, label long")
    for low in reversed(rounds):
        higher = final.select(F.col("v").alias("_v"), "label")
        final = low.join(higher, low["low"] == higher["_v"], "left").select("v", F.coalesce("label", "low").alias("label"))
    return final


def components(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """``(component_root, vert)``: one row for each vertex id in the given columns, with the smallest id of its component.

    Each table comes with the names of its two columns; a row with vertex ids at both ends links them. A row with one vertex
    id brings that vertex without a link; NULL, 4294967295 and values outside the domain are no vertices. Self-pairs, repeated
    and reversed rows change nothing. Empty tables bring nothing; without any vertex the result is empty.
    """
    spark = tables[0][0].sparkSession
    ws = Workspace(spark, "components")
    links = reduce(DataFrame.unionByName, (_ends(t, a, b) for t, a, b in tables))
    spanning = ws.cut(links.mapInArrow(_contract, CONTRACTED).groupBy("a", "b").agg(F.sum("n").alias("n")))
    edges, seen = ws.cut_measured(spanning.where("a <> b").select("a", "b"), n=F.count(F.lit(1)))
    verts = spanning.select(F.col("b").alias("vert")).distinct()
    if not seen["n"]:
        return verts.select(F.col("vert").alias("component_root"), "vert")
    degrees = spanning.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("n"))
    giant, rest = _peel(ws, edges, seen["n"], degrees.orderBy(F.desc("n"), "v").limit(1).select("v"))
    rest, seen = ws.cut_measured(rest, n=F.count(F.lit(1)))
    final = ws.cut(_propagate(ws, rest, seen["n"]))
    roots = final.groupBy("label").agg(F.min("v").alias("component_root"))
    small = final.join(roots, "label").select("component_root", F.col("v").alias("vert"))
    # The giant's root is its smallest vertex, or that of the tails that hang on it.
    rep = giant.agg(F.min("v").alias("vert")).join(small, "vert", "left").select(F.coalesce("component_root", "vert").alias("component_root"))
    peeled = giant.join(F.broadcast(rep)).select("component_root", F.col("v").alias("vert"))
    labelled = ws.cut(small.unionByName(peeled).distinct())
    alone = verts.join(labelled.select("vert"), "vert", "left_anti").select(F.col("vert").alias("component_root"), "vert")
    return labelled.unionByName(alone)
