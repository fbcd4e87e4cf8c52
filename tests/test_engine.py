import math
import random

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import algorithms as A
from vertexloom.operators import engine
from vertexloom.operators.diagnostics import update_skew
from vertexloom.operators.engine import VertexProgram
from vertexloom.operators.graph import Graph
from vertexloom.plans import registry

GOLDEN = [(0, 1, 2), (0, 2, 5), (1, 2, 1), (2, 0, 4), (2, 3, 1), (3, 4, 2), (3, 4, 7), (4, 3, 3), (4, 4, 1), (6, 7, 2), (7, 8, 2), (8, 6, 2), (8, 9, 1)]
BOTH = pytest.mark.parametrize("in_task", [engine.IN_TASK, 0])


def graph(spark, edges, weighted=True):
    df = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")
    return Graph.from_edges(df, weight="weight" if weighted else None)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def golden(spark):
    return graph(spark, GOLDEN)


@BOTH
def test_golden_paths(golden, in_task):
    assert column(A.bfs(golden, 0, in_task), "level") == [0, 1, 1, 2, 3] + [None] * 5
    tree = A.sssp(golden, 0, in_task)
    assert column(tree, "value") == [0, 2, 3, 4, 6] + [math.inf] * 5
    assert column(tree, "predecessor") == [None, 0, 1, 2, 3] + [None] * 5


@BOTH
def test_golden_ranks(golden, in_task):
    assert column(A.pagerank(golden, 1, in_task), "rank") == pytest.approx([1.575, 1.575, 2.575, 2.15, 2.725, 1, 1.575, 2, 2, 1.575])
    two = [2.819375, 2.394375, 4.883125, 4.7025, 6.160625, 1, 2.575, 3.48875, 3.85, 2.575]
    assert column(A.pagerank(golden, 2, in_task), "rank") == pytest.approx(two)


@BOTH
def test_golden_components(golden, in_task):
    weak = A.wcc(golden, in_task)
    assert column(weak, "component_root") == [0, 0, 0, 0, 0, 5, 6, 6, 6, 6]
    assert A.component_count(weak).first()[0] == 3
    assert column(A.scc(golden, in_task=in_task), "component_root") == [0, 0, 0, 3, 3, 5, 6, 6, 6, 9]


def test_golden_rest(spark, golden):
    assert column(A.spmv(golden), "spmv_value") == [4, 2, 6, 4, 10, 0, 2, 2, 2, 1]
    assert column(A.spmv(golden, spark.createDataFrame([(0, 10.0), (77, 1.0)], "id long, value double")), "spmv_value") == [4, 20, 51, 4, 10, 0, 2, 2, 2, 1]
    assert column(golden.csr_index(), "offset") == [1, 3, 4, 6, 8, 0, 10, 11, 12, 0]
    assert column(golden.csc_index(), "offset") == [1, 2, 3, 5, 7, 0, 10, 11, 12, 13]
    assert column(golden.degrees(), "out_degree") == [2, 1, 2, 2, 2, 0, 1, 1, 2, 0]
    assert column(golden.in_degrees(), "in_degree") == [1, 1, 2, 2, 3, 0, 1, 1, 1, 1]
    assert golden.describe().first().asDict() == {"min_vertex_id": 0, "max_vertex_id": 9, "num_of_edges": 13, "max_out_edges": 2, "edge_type": 1, "with_in_edge": 1}
    ids = spark.createDataFrame([(4,), (4,)], "id long")
    assert golden.out_edges(ids).count() == 2 and golden.in_edges(ids).count() == 3
    assert sorted(map(tuple, engine.expand(golden, spark.createDataFrame([(3,), (4,)], "id long")).collect())) == [(3, 1), (4, 2)]
    assert len(A.first_rows(A.spmv(golden), 3).collect()) == 3


@BOTH
def test_errors(spark, golden, in_task):
    plain = graph(spark, GOLDEN, weighted=False)
    for call in (
        lambda: A.sssp(plain, 0, in_task), lambda: A.spmv(plain), lambda: A.bfs(golden, 9, in_task).collect(), lambda: A.bfs(golden, 5, in_task).collect(),
        lambda: A.bfs(golden, 10, in_task), lambda: A.sssp(golden, -1, in_task), lambda: A.pagerank(golden, 0, in_task),
        lambda: registry.run("demo", golden), lambda: registry.run("bfs", golden, niters=3),
        lambda: A.scc(Graph(golden.edges, 9, True, with_in_edges=False), in_task=in_task), lambda: A.wcc(Graph(golden.edges, 9, True, with_in_edges=False), in_task),
    ):
        with pytest.raises(ValueError):
            call()


def test_negative_cycle_is_an_error(spark):
    bad = graph(spark, [(0, 1, 1), (1, 2, -5), (2, 0, 1)])
    with pytest.raises(ValueError, match="negative"):
        A.sssp(bad, 0, in_task=0)
    with pytest.raises(Exception, match="negative"):
        A.sssp(bad, 0).collect()


@BOTH
def test_graph_without_edges(spark, in_task):
    empty = graph(spark, [])
    assert empty.max_id == -1
    assert A.wcc(empty, in_task).count() == A.scc(empty, in_task=in_task).count() == A.pagerank(empty, 1, in_task).count() == empty.csr_index().count() == 0
    only = Graph.from_edges(spark.createDataFrame([(None, 1, 1.0), (4294967295, 2, 1.0), (-1, 1, 1.0)], "src long, dst long, weight double"), max_id=2)
    assert only.num_edges == 0 and column(A.wcc(only, in_task), "component_root") == [0, 1, 2]


def test_buckets_and_kernels_agree(spark):
    """Several buckets, so that messages really move; random graphs with loops, repeats and gaps."""
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randint(1, 9)) for _ in range(110)] + [(70, 71, 1), (71, 70, 1)]
    g = graph(spark, edges)
    root = edges[0][0]
    reach = A.bfs_program(root)
    assert column(engine.run(g, reach, edges_per_bucket=30, in_task=0), "level") == column(A.bfs(g, root), "level")
    assert column(engine.run(g, A.sssp_program(root), edges_per_bucket=30, in_task=0), "value") == column(A.sssp(g, root), "value")
    weak, strong = column(engine.run(g, A.wcc_program(), edges_per_bucket=30, in_task=0), "component_root"), column(A.scc(g), "component_root")
    assert weak == column(A.wcc(g), "component_root")
    assert column(A.scc(g, edges_per_bucket=40, in_task=0), "component_root") == strong
    ranks = column(engine.run(g, A.pagerank_program(3), edges_per_bucket=30, in_task=0), "rank")
    assert ranks == pytest.approx(column(A.pagerank(g, 3), "rank"))
    assert all(w <= s for w, s in zip(weak, strong)) and all(weak[w] == w for w in weak)
    unit = graph(spark, [(a, b, 1) for a, b, _ in edges])
    levels = column(A.bfs(g, root), "level")
    assert [None if v == math.inf else v for v in column(A.sssp(unit, root), "value")] == levels
    assert sum(column(A.spmv(g), "spmv_value")) == sum(w for _, _, w in edges)
    assert all(levels[b] <= levels[a] + 1 for a, b, _ in edges if levels[a] is not None)


def test_one_exchange_per_superstep(spark):
    """The state and the edges stay where they are; only the combined messages move."""
    g = graph(spark, [(i, (i * 7) % 50, 1) for i in range(50)] * 3)
    p = A.wcc_program()
    run = engine.Run(engine.arcs(g, p), 300, p, edges_per_bucket=100, least_buckets=1)
    state, _ = run.start(g.vertices())
    assert run.buckets == 3
    plan = run.ws._bound(run.superstep(state).withColumn("x", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan


def test_hot_sources_are_spread(spark, monkeypatch):
    """Half of all arcs start at one vertex and end at another: the same results, and no bucket holds the hot vertex's arcs."""
    monkeypatch.setattr(engine, "COOL", 20)
    rng = random.Random(3)
    g = graph(spark, [(0, rng.randrange(300), 1) for _ in range(300)] + [(rng.randrange(300), 7, 2) for _ in range(300)] + [(i, (i * 11) % 300, 3) for i in range(300)])
    for p in (A.wcc_program(), A.bfs_program(0), A.sssp_program(0), A.pagerank_program(2)):
        n = g.num_edges * (2 if p.direction == "both" else 1)
        run = engine.Run(engine.arcs(g, p), n, p, least_buckets=6)
        assert run.hot is not None and run.buckets == 6
        per_bucket = [r["n"] for r in run.arcs.groupBy(F.spark_partition_id()).agg(F.count("src").alias("n")).collect()]
        assert max(per_bucket) < n / 3 and run.arcs.count() + run.hot.count() == engine.arcs(g, p).count()
        for c in p.output or p.state:
            got, want = column(engine.run(g, p, in_task=0, least_buckets=6), c), column(engine.run(g, p), c)
            assert got == (pytest.approx(want) if p.name == "pagerank" else want)
    assert sorted(map(tuple, A.scc(g, in_task=0).collect())) == sorted(map(tuple, A.scc(g).collect()))


def test_buckets_never_reach_spark_s_limit(spark, monkeypatch):
    monkeypatch.setattr(engine, "MOST_BUCKETS", 3)
    g = graph(spark, [(i, i + 1, 1) for i in range(40)])
    run = engine.Run(engine.arcs(g, A.bfs_program(0)), 40, A.bfs_program(0), edges_per_bucket=1)
    assert run.buckets == 3 and engine.MOST_BUCKETS < 100_000


def test_few_active_vertices_read_their_buckets_only(spark, monkeypatch):
    monkeypatch.setattr(engine, "MANY_BUCKETS", 8)
    g = graph(spark, [(i, i + 1, 1) for i in range(40)])
    p = A.bfs_program(0)
    run = engine.Run(engine.arcs(g, p), 40, p, edges_per_bucket=4)
    state, active = run.start(g.vertices())
    plan = run.superstep(state, active)._jdf.queryExecution().executedPlan().toString()
    assert run.buckets == 10 and "SelectedBucketsCount: 1 out of 10" in plan
    assert column(engine.run(g, p, edges_per_bucket=4, in_task=0), "level") == list(range(41))


def test_own_program(spark, golden):
    """The user's surface: the largest id that reaches each vertex, against the edges."""
    seen = []
    largest = VertexProgram(
        "largest", {"top": "id"}, "top", "max(msg)", "msg > top", {"top": "msg"}, direction="in",
        before_iteration=lambda step: seen.append(step), after_iteration=lambda step, active: True, finalize=lambda steps: seen.append(-steps),
    )
    assert column(engine.run(golden, largest), "top") == [4, 4, 4, 4, 4, 5, 9, 9, 9, 9]
    assert seen == [*range(len(seen) - 1), 1 - len(seen)]


def test_update_skew(spark, golden):
    row = update_skew(golden.edges, 4).first()
    assert row["updates"] == 13 and row["fullest"] == 5 and row["lanes_used"] == 4
    assert update_skew(graph(spark, []).edges, 4).first()["cv"] is None


@BOTH
def test_edges_without_a_weight_carry_no_message(spark, in_task):
    edges = [(0, 1, 2.0), (2, 1, None), (0, 2, 1.0), (1, 3, 5.0), (2, 3, None), (0, 3, math.nan), (0, 3, 9.0), (4, 3, None), (4, 0, math.nan)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double"), weight="weight")
    tree = A.sssp(g, 0, in_task)
    assert column(tree, "value") == [0, 2, 1, 7, math.inf]
    assert column(tree, "predecessor") == [None, 0, 0, 1, None]
    with pytest.raises(ValueError, match="reaches no other"):
        A.sssp(g, 4, in_task).collect()
