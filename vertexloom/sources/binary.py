"""Graphs in the binary layout: ``.index`` (u64 per vertex: 1-based number of its first edge, 0 for none) and ``.edge`` (records
``{u32 dest; f32 weight}`` or ``{u32 dest}`` in order of their source; record 0 is unused). ``.in-index`` and ``.in-edge`` (records ``{u32 src}``) are the same by destination.

A task takes a range of vertices: its part of the index gives the slots of all its edges, which lie side by side, so both files
are read in pieces, each once. The files have to be visible to the executors under the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators.graph import Graph

VERTICES_PER_TASK, EDGES_PER_READ = 1 << 20, 1 << 22
WEIGHTED = np.dtype([("dest", "<u4"), ("weight", "<f4")])
PLAIN = np.dtype([("dest", "<u4")])
# Fixed: indexes are padded with zeros to a multiple of so many entries.
PADDING = 4 << 20


def _piece(path: str, kind: np.dtype, first: int, n: int) -> np.ndarray:
    return np.fromfile(path, kind, max(0, n), offset=first * kind.itemsize)


def _next_start(index: str, vertex: int, vertices: int, end: int) -> int:
    """The first slot that belongs to ``vertex`` or a later one."""
    for at in range(vertex, vertices, VERTICES_PER_TASK):
        some = _piece(index, np.dtype("<u8"), at, min(VERTICES_PER_TASK, vertices - at))
        if (some > 0).any():
            return int(some[some > 0][0])
    return end


def _reader(index: str, edge: str, kind: np.dtype, vertices: int, edges: int, key: str = "src", other: str = "dst"):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                base = piece * VERTICES_PER_TASK
                start = _piece(index, np.dtype("<u8"), base, min(VERTICES_PER_TASK, vertices - base)).astype(np.int64)
                has = np.flatnonzero(start)
                if not len(has):
                    continue
                stop = _next_start(index, base + VERTICES_PER_TASK, vertices, edges + 1)
                for slot in range(int(start[has[0]]), stop, EDGES_PER_READ):
                    rows = _piece(edge, kind, slot, min(EDGES_PER_READ, stop - slot))
                    of = np.searchsorted(start[has], np.arange(slot, slot + len(rows)), side="right") - 1
                    cols = {key: base + has[of], other: rows["dest"].astype(np.int64)}
                    if "weight" in kind.names:
                        cols["weight"] = rows["weight"].astype(np.float64)
                    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})

    return run


def binary_graph(spark: SparkSession, prefix: str, max_id: int, num_edges: int, weighted: bool, with_in_edges: bool = False) -> Graph:
    """The graph in ``<prefix>.index`` and ``<prefix>.edge``, and with ``with_in_edges`` in ``<prefix>.in-index`` and ``<prefix>.in-edge``
    too; the sizes are those of its description."""
    for name in (f"{prefix}.index", f"{prefix}.edge", *([f"{prefix}.in-index", f"{prefix}.in-edge"] if with_in_edges else [])):
        if not os.path.exists(name):
            raise FileNotFoundError(name)
    pieces = max(1, -(-(max_id + 1) // VERTICES_PER_TASK))
    read = _reader(f"{prefix}.index", f"{prefix}.edge", WEIGHTED if weighted else PLAIN, max_id + 1, num_edges)
    rows = spark.range(0, pieces, 1, pieces).mapInArrow(read, "src long, dst long" + ", weight double" * weighted)
    by_dst = None
    if with_in_edges:
        back = _reader(f"{prefix}.in-index", f"{prefix}.in-edge", PLAIN, max_id + 1, num_edges, "dst", "src")
        by_dst = spark.range(0, pieces, 1, pieces).mapInArrow(back, "dst long, src long")
    return Graph(rows, max_id, weighted, with_in_edges, num_edges, by_dst)


def _allocate(path: str, size: int) -> None:
    with open(path, "wb") as f:
        f.truncate(size)


def _writer(index: str, edge: str, kind: np.dtype, slots: dict[int, int], key: str, other: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        with open(index, "r+b") as heads, open(edge, "r+b") as records:
            for batch in batches:  # sorted by the key, so a vertex's first edge is met first
                keys = batch.column(key).to_numpy()
                if not len(keys):
                    continue
                piece = int(keys[0]) // VERTICES_PER_TASK
                slot = at.setdefault(piece, slots[piece])
                rows = np.zeros(len(keys), kind)
                rows["dest"] = batch.column(other).to_numpy()
                if "weight" in kind.names:
                    rows["weight"] = batch.column("weight").to_numpy()
                records.seek(slot * kind.itemsize)
                records.write(rows.tobytes())
                first = np.flatnonzero(np.concatenate([[int(keys[0]) != at.get(-1, -1)], keys[1:] != keys[:-1]]))
                for i in first.tolist():
                    heads.seek(int(keys[i]) * 8)
                    heads.write(int(slot + i).to_bytes(8, "little"))
                at[piece], at[-1] = slot + len(keys), int(keys[-1])
        yield pa.RecordBatch.from_arrays([pa.array([sum(v for k, v in at.items() if k >= 0)])], names=["end"])

    return run


def _write(rows: DataFrame, max_id: int, edges: int, index: str, edge: str, kind: np.dtype, key: str, other: str) -> None:
    """Tasks write disjoint parts of files of known size, so one that runs again writes the same bytes again."""
    _allocate(index, -(-(max_id + 1) // PADDING) * PADDING * 8)
    _allocate(edge, (edges + 1) * kind.itemsize)
    pieces = max(1, -(-(max_id + 1) // VERTICES_PER_TASK))
    rows = rows.withColumn("_piece", F.floor(F.col(key) / VERTICES_PER_TASK).cast("int"))
    counts = {r["_piece"]: r["n"] for r in rows.groupBy("_piece").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row in a million vertices
    slots, at = {}, 1
    for piece in range(pieces):
        slots[piece], at = at, at + counts.get(piece, 0)
    placed = rows.repartitionById(pieces, "_piece").sortWithinPartitions(key, other, *(["weight"] if "weight" in kind.names else [])).drop("_piece")
    placed.mapInArrow(_writer(index, edge, kind, slots, key, other), "end long").agg(F.count("end")).collect()


def save_binary(graph: Graph, prefix: str, in_edges: bool = False) -> None:
    """Write the graph's edges, and with ``in_edges`` those by destination, in the binary layout; sorted by both ends."""
    n = graph.num_edges if graph.num_edges is not None else graph.edges.count()
    kind = WEIGHTED if graph.weighted else PLAIN
    _write(graph.edges, graph.max_id, n, f"{prefix}.index", f"{prefix}.edge", kind, "src", "dst")
    if in_edges:
        _write(graph.edges.select("src", "dst"), graph.max_id, n, f"{prefix}.in-index", f"{prefix}.in-edge", PLAIN, "dst", "src")
