import os
import numpy as np
import pytest

from vertexloom.operators import algorithms as A
from vertexloom.plans import cli
from vertexloom.operators.graph import Graph
from vertexloom.sources import binary, store, text
from vertexloom.streaming import edges as stream

EDGES = "0 1 2,0 2 5,1 2 1,2 0 4,2 3 1,3 4 2,3 4 7,4 3 3,4 4 1,6 7 2,7 8 2,8 6 2,8 9 1".split(",")


@pytest.fixture
def edge_file(tmp_path):
    path = tmp_path / "e.txt"
    path.write_text("# head\n\n" + "\n".join(e.replace(" ", "\t") for e in reversed(EDGES)) + "\n  # tail\n")
    return str(path)


def rows(graph):
    return sorted(map(tuple, graph.edges.collect()))


def test_edge_list(spark, edge_file):
    want = sorted((int(a), int(b), float(w)) for a, b, w in (e.split() for e in EDGES))
    assert rows(text.edge_list(spark, edge_file, weighted=True)) == want
    assert rows(text.edge_list(spark, edge_file)) == [r[:2] for r in want]


def test_drawn_weights(spark, tmp_path):
    (tmp_path / "e.txt").write_text("\n".join(f"{i} {i + 1}" for i in range(200)))
    a, b, c = (rows(text.edge_list(spark, str(tmp_path / "e.txt"), True, seed)) for seed in (1, 1, 2))
    assert a == b != c and all(0 <= w < 10 for _, _, w in a) and len({w for _, _, w in a}) > 100


def test_malformed_edges(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n3\n4 x\n5 6 7 8\n9 4294967295\n7 8 heavy\n")
    with pytest.raises(Exception, match="no edge"):
        text.edge_list(spark, str(tmp_path / "e.txt"))
    assert rows(text.edge_list(spark, str(tmp_path / "e.txt"), on_error="drop")) == [(1, 2)]


def test_adjacency_list(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("8 2 6 9\n# c\n0 2 1 2\n12 0\n5 3 5 5 5\n" + "20 3000 " + " ".join(map(str, range(3000))) + "\n")
    g = text.adjacency_list(spark, str(path))
    assert g.num_edges == 3007 and g.max_id == 2999 and rows(g)[:3] == [(0, 1), (0, 2), (5, 5)]
    assert text.adjacency_list(spark, str(path), weighted=True).weighted
    for bad in ("1 2 3\n", "1 x\n", "1\n", "1 1 y\n"):
        path.write_text(bad)
        with pytest.raises(Exception, match="no adjacency row"):
            text.adjacency_list(spark, str(path)).edges.collect()


def test_a_row_without_neighbours_widens_the_domain(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1 2\n7 0\n")
    assert text.adjacency_list(spark, str(tmp_path / "a.txt")).max_id == 7


def test_store_round_trip(spark, edge_file, tmp_path):
    g = text.edge_list(spark, edge_file, weighted=True)
    out = str(tmp_path / "g")
    described = store.save_graph(g, out, in_edges=True)
    assert described == {"min_vertex_id": 0, "max_vertex_id": 9, "num_of_edges": 13, "max_out_edges": 2, "edge_type": 1, "with_in_edge": 1} == store.read_description(spark, out)
    back = store.load_graph(spark, out)
    assert rows(back) == rows(g) and back.max_id == 9 and back.weighted
    assert spark.read.parquet(f"{out}/in_edges").count() == 13 and spark.read.parquet(f"{out}/index").count() == spark.read.parquet(f"{out}/in_index").count() == 10
    store.save_result(A.bfs(back, 0), f"{out}/levels", sentinels=True)
    assert [r["level"] for r in spark.read.parquet(f"{out}/levels").orderBy("id").collect()] == [0, 1, 1, 2, 3] + [4294967295] * 5
    store.save_sorted_text(back, f"{out}/text", "dst")
    assert sorted(r["value"] for r in spark.read.text(f"{out}/text").collect())[0] == "0\t1\t2.0"
    with pytest.raises(FileNotFoundError):
        store.load_graph(spark, str(tmp_path))


def test_command_line(spark, edge_file, tmp_path):
    out, result = str(tmp_path / "g"), str(tmp_path / "r")
    assert cli.main(["convert", "-g", edge_file, "-t", "edgelist", "-d", out, "-o", "type1", "-i", "1"]) == 0
    assert cli.main(["run", "-g", out, "-a", "cc", "-i", "1", "-d", result]) == 0
    assert [r["component_root"] for r in spark.read.parquet(result).orderBy("id").collect()] == [0, 0, 0, 0, 0, 5, 6, 6, 6, 6]
    assert cli.main(["run", "-g", out, "-a", "pagerank", "--pagerank::niters", "1"]) == 0
    assert cli.main(["convert", "-g", edge_file, "-t", "edgelist", "-d", out, "-o", "type2"]) == 0
    for bad in (["-a", "sssp"], ["-a", "cc"], ["-a", "cc", "-i", "1"], ["-a", "demo"]):
        with pytest.raises(ValueError):
            cli.main(["run", "-g", out, *bad])


def test_edge_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, lines in enumerate(("1 2\n# c\nx y\n", '2\t3\n"1" 2\n1 4294967295\n')):
        (tmp_path / "in" / f"{i}.txt").write_text(lines)
    edges = stream.read_edge_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    for _ in range(2):  # a second run finds nothing new
        stream.store_edges(edges, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 2), (1, 2), (2, 3)]
    query = stream.running_degrees(edges).writeStream.outputMode("complete").format("memory").queryName("degrees").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("degrees").collect())) == [(1, 2, 0), (2, 1, 2), (3, 0, 1)]


@pytest.mark.parametrize("weighted", [True, False])
def test_binary_graph(spark, tmp_path, monkeypatch, weighted):
    """Written here from the layout's definition: slot 0 unused, zero-padded index, pieces smaller than the graph."""
    import numpy as np

    from vertexloom.sources import binary

    monkeypatch.setattr(binary, "VERTICES_PER_TASK", 3)
    monkeypatch.setattr(binary, "EDGES_PER_READ", 2)
    ends = sorted(tuple(map(int, e.split())) for e in EDGES)
    record = binary.WEIGHTED if weighted else binary.PLAIN
    edge, index = np.zeros(len(ends) + 1, record), np.zeros(16, "<u8")
    for slot, (src, dst, weight) in enumerate(ends, 1):
        edge[slot] = (dst, weight) if weighted else (dst,)
        index[src] = index[src] or slot
    edge.tofile(tmp_path / "g.edge")
    index.tofile(tmp_path / "g.index")
    g = binary.binary_graph(spark, str(tmp_path / "g"), 9, len(ends), weighted)
    assert rows(g) == ([(a, b, float(w)) for a, b, w in ends] if weighted else [(a, b) for a, b, _ in ends])
    with pytest.raises(FileNotFoundError):
        binary.binary_graph(spark, str(tmp_path / "h"), 9, 13, weighted)


@pytest.mark.parametrize("weighted", [True, False])
def test_binary_round_trip_in_pieces(spark, tmp_path, monkeypatch, weighted):
    """Vertices of many pieces, some without edges, a hot one; by source and by destination."""
    monkeypatch.setattr(binary, "VERTICES_PER_TASK", 4)
    monkeypatch.setattr(binary, "EDGES_PER_READ", 3)
    edges = [(0, 9, 1.5), (0, 9, 1.5), (1, 0, 2.0), (13, 9, 0.0), (13, 13, 4.0)] + [(9, i % 15, float(i)) for i in range(30)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(3)
    g = Graph.from_edges(df, weight="weight" if weighted else None, max_id=21)
    prefix = str(tmp_path / "g")
    binary.save_binary(g, prefix, in_edges=True)
    back = binary.binary_graph(spark, prefix, 21, len(edges), weighted, with_in_edges=True)
    plain = sorted((a, b) for a, b, _ in edges)
    assert sorted(tuple(r) for r in back.edges.collect()) == (sorted(edges) if weighted else plain)
    assert sorted((r["src"], r["dst"]) for r in back.by_dst.collect()) == plain
    assert os.path.getsize(f"{prefix}.index") == os.path.getsize(f"{prefix}.in-index") == binary.PADDING * 8
    heads = np.fromfile(f"{prefix}.index", "<u8", 22)
    assert heads.tolist() == [r["offset"] for r in g.csr_index().orderBy("id").collect()]
    assert [tuple(r) for r in back.in_degrees().orderBy("id").collect()] == [tuple(r) for r in g.in_degrees().orderBy("id").collect()]


def test_stored_in_edges_are_read(spark, tmp_path):
    g = Graph.from_edges(spark.createDataFrame([(0, 1), (2, 1), (1, 1), (3, 0)], "src long, dst long"))
    store.save_graph(g, str(tmp_path / "g"), in_edges=True)
    back = store.load_graph(spark, str(tmp_path / "g"))
    found = back.in_edges(spark.createDataFrame([(1,)], "id long"))
    assert sorted((r["src"], r["dst"]) for r in found.collect()) == [(0, 1), (1, 1), (2, 1)]
    assert all(f"{tmp_path}/g/in_edges" in name for name in found.inputFiles())
    assert back.without_self_loops().transposed().edges.count() == 3
    assert sorted(map(tuple, store.load_index(spark, str(tmp_path / "g"), "dst").collect())) == [(0, 1), (1, 2), (2, 0), (3, 0)]


def test_rejected_lines_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('1 2\n# no line\nx 2\n1 2 3\n"1 2\n\n')
    query = stream.read_rejects(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("rejects").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("rejects").collect()) == [("", "column_count"), ('"1 2', "quoting"), ("1 2 3", "column_count"), ("x 2", "src_vert")]


def test_steps_go_at_the_end_of_a_scope(spark):
    from vertexloom.operators import hierarchy
    from vertexloom.plans import lineage

    before, tables = set(lineage._open), spark.catalog.listTables()
    width = spark.conf.get("spark.sql.shuffle.partitions")
    with lineage.scope():
        links = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent long")
        assert hierarchy.solve(links).count() == 3
        roots = [r for r in lineage._open if r not in before]
        assert roots and all(os.path.exists(r.removeprefix("file:").replace("///", "/")) for r in roots)
    assert set(lineage._open) == before and not any(os.path.exists(r.removeprefix("file:").replace("///", "/")) for r in roots)
    assert spark.catalog.listTables() == tables and spark.conf.get("spark.sql.shuffle.partitions") == width


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from vertexloom.plans import lineage

    nowhere = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: nowhere, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(SimpleNamespace(conf=nowhere, sparkContext=context))
    context.master = "local[2]"
    assert lineage.shared_dir(SimpleNamespace(conf=nowhere, sparkContext=context)).startswith("file://")
