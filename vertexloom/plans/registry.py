"""The algorithms by the names they are run with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vertexloom.operators import algorithms
from vertexloom.operators.graph import Graph

_RUNS: dict[str, tuple[Callable[..., DataFrame], dict[str, str]]] = {
    "bfs": (algorithms.bfs, {"bfs_root": "root"}),
    "sssp": (algorithms.sssp, {"source": "source"}),
    "pagerank": (algorithms.pagerank, {"niters": "iterations"}),
    "spmv": (algorithms.spmv, {"x": "x"}),
    "cc": (algorithms.wcc, {}),
    "scc": (algorithms.scc, {}),
}


def names() -> list[str]:
    return sorted(_RUNS)


def register(name: str, run: Callable[..., DataFrame], options: dict[str, str] | None = None) -> None:
    """Add an algorithm: ``run(graph, **options)`` gives a row for each vertex."""
    _RUNS[name] = (run, options or {})


def run(name: str, graph: Graph, **options: object) -> DataFrame:
    """Run an algorithm by name; unknown names and options are errors."""
    if name not in _RUNS:
        raise ValueError(f"no algorithm {name!r}; there are {', '.join(names())}")
    call, known = _RUNS[name]
    unknown = sorted(set(options) - set(known))
    if unknown:
        raise ValueError(f"{name} has no option {', '.join(unknown)}")
    return call(graph, **{known[k]: v for k, v in options.items()})
