import math

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, same
from vertexloom import queries
from vertexloom.sources import tables

SLOW = {"bfs_supersteps", "sssp_supersteps", "scc_supersteps"}  # covered by test_engine on smaller graphs


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - SLOW))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["endpoint", "vert", "degree", "distinct_neighbours", "smallest_neighbour"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_graph_query_runs_on_the_whole_table_of_edges():
    of_slots = {"graph_desc": "slot_desc", "out_degree": "slot_degrees", "in_degree": "slot_degrees", "scc_sparse": "slot_scc"}
    of_slots |= {"pagerank": "slot_pagerank10", "pagerank_trade": "trade_pagerank10", "pagerank_supersteps": "slot_pagerank10_supersteps"}
    filtered = [f.__name__ for f in queries.GRAPH if not f.__name__.startswith(("slot_", "trade_"))]
    assert {of_slots.get(n, f"slot_{n}") for n in filtered} <= set(queries.QUERIES)


def test_whole_table_of_edges_against_brute_force(spark, tmp_path):
    """Every edge counts, with a weight or without; no weight: no message and nothing in a sum."""
    rows = [(1, 0, 1, 2.0), (1, 0, 1, 2.0), (2, 0, 2, None), (3, 0, 2, math.nan), (4, 0, 2, -1.0), (5, 1, 2, 0.0), (6, 2, 3, 1.5), (7, 2, 2, 4.0), (8, 3, 0, 0.25), (9, 3, None, 1.0), (10, 3, 4294967295, 1.0)]
    spark.createDataFrame(rows, "slot long, src long, dest_vert long, weight float").coalesce(1).write.parquet(f"{tmp_path}/edge.parquet")
    run = lambda name, *cols: [tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, str(tmp_path)).orderBy("id").collect()]
    assert run("slot_degrees", "out_degree", "in_degree") == [(4, 1), (1, 1), (2, 5), (1, 1)]
    assert run("slot_csr_index", "offset") == [(1,), (5,), (6,), (8,)]
    assert run("slot_spmv", "spmv_value") == [(0.25,), (2.0,), (4.0,), (1.5,)]
    for name in ("slot_sssp", "slot_sssp_supersteps"):
        assert run(name, "value") == [(0.0,), (2.0,), (2.0,), (3.5,)]
    assert run("slot_sssp_tree", "predecessor") == [(None,), (0,), (1,), (2,)]
    for name in ("slot_scc", "slot_scc_supersteps"):
        assert run(name, "component_root") == [(0,)] * 4


@pytest.mark.parametrize("name, graph", [("slot_pagerank10", tables.slot_graph), ("trade_pagerank10", lambda spark, folder: tables.trade_graph(spark, folder, None))])
def test_ranks_of_whole_tables_take_the_default_iterations(spark, name, graph):
    folder = f"{DATA}/sf0.001"
    g = graph(spark, folder)
    ranks, out = [1.0] * (g.max_id + 1), [0] * (g.max_id + 1)
    edges = [(r["src"], r["dst"]) for r in g.edges.collect()]
    for a, _ in edges:
        out[a] += 1
    for _ in range(10):
        new = list(ranks)
        for a, b in edges:
            new[b] += 0.85 * ranks[a] / out[a] + 0.15
        ranks = new
    assert [r["rank"] for r in queries.QUERIES[name](spark, folder).orderBy("id").collect()] == pytest.approx(ranks, rel=1e-6)
    if name.startswith("trade"):
        assert len(edges) == spark.read.parquet(f"{folder}/lineitem.parquet").count()
