"""The engine's registered queries and, where SQL can express them, their SQL. Each takes (spark, folder of Parquet tables)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators import algorithms, diagnostics, engine, hierarchy, salted, strict_load
from vertexloom.operators.graph import Graph
from vertexloom.plans.lineage import Workspace
from vertexloom.sources import binary, store, tables, text

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.solve(hierarchy.current_links(table(spark, folder, "sssp_vert_attr"))).select("id", "root", "depth")


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.current_links(table(spark, folder, "sssp_vert_attr"))).select("id", "parent", "root", "depth", "size", "pre", "chain", "pos")


def p1_chains(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.chains(p1_hierarchy(spark, folder)).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ">"))


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    hop = lambda h: F.concat_ws(":", h["chain"].cast("string"), h["upto"].cast("string"))
    return hierarchy.path_hops(p1_hierarchy(spark, folder)).withColumn("hops", F.array_join(F.transform("hops", hop), ">"))


def _asked(nodes: DataFrame) -> DataFrame:
    """The stated query set: all ids divisible by 50, against all rows."""
    return nodes.where("id % 50 = 0").select("id")


def p1_full_paths(spark: SparkSession, folder: str) -> DataFrame:
    nodes = p1_hierarchy(spark, folder)
    paths = hierarchy.full_paths(nodes, _asked(nodes))
    return paths.select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    nodes = p1_hierarchy(spark, folder)
    return hierarchy.descendants(nodes, _asked(nodes))


def hierarchy_levels(spark: SparkSession, folder: str) -> DataFrame:
    """``p1_found`` by many levels of contraction: partitions of 2,000 nodes, and no quotient of more than 200 in one task."""
    links = hierarchy.current_links(table(spark, folder, "sssp_vert_attr"))
    return hierarchy.solve(links, rows_per_part=2000, base=200).select("id", "root", "depth")


def p1_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return p1_hierarchy(spark, folder).where("depth >= 0").select("id", "root", "depth", F.col("size").alias("nodes_below_and_self"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return salted.heavy_endpoints(salted.endpoint_stats(table(spark, folder, "tmp_in_edge")), one_in=50)


def p4_endpoint_stats(spark: SparkSession, folder: str) -> DataFrame:
    return salted.endpoint_stats(table(spark, folder, "tmp_in_edge"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return strict_load.load_edges(table(spark, folder, "process_edgelist")).rejected.select("line_no", "reason")


def p5_edges(spark: SparkSession, folder: str) -> DataFrame:
    return strict_load.load_edges(table(spark, folder, "process_edgelist")).edges.select("line_no", "src_vert", "dst_vert")


# The ranks' last digits depend on the order of the sums; as in the binary format, 24 bits of them count.
RANK = "CAST(CAST(rank AS FLOAT) AS DOUBLE) AS rank"


def graph_desc(spark: SparkSession, folder: str) -> DataFrame:
    return tables.part_graph(spark, folder).describe()


def out_degree(spark: SparkSession, folder: str) -> DataFrame:
    return tables.part_graph(spark, folder).out_degrees()


def in_degree(spark: SparkSession, folder: str) -> DataFrame:
    return tables.part_graph(spark, folder).in_degrees()


def csr_index(spark: SparkSession, folder: str) -> DataFrame:
    return tables.part_graph(spark, folder).csr_index()


def csc_index(spark: SparkSession, folder: str) -> DataFrame:
    return tables.part_graph(spark, folder).csc_index()


def self_loops(spark: SparkSession, folder: str) -> DataFrame:
    return tables.trade_graph(spark, folder).edges.where("src = dst").groupBy("src").agg(F.count(F.lit(1)).alias("loops"))


def spmv(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.spmv(tables.part_graph(spark, folder))


def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.pagerank(tables.part_graph(spark, folder)).selectExpr("id", RANK)


def pagerank_trade(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.pagerank(tables.trade_graph(spark, folder), 3).selectExpr("id", RANK)


def bfs(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.part_graph(spark, folder)
    return algorithms.bfs(g, tables.busiest_source(g))


def sssp(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.part_graph(spark, folder)
    return algorithms.sssp(g, tables.busiest_source(g)).select("id", "value")


def sssp_tree(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.part_graph(spark, folder)
    return algorithms.sssp(g, tables.busiest_source(g))


def wcc(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.wcc(tables.part_graph(spark, folder))


def wcc_count(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.component_count(wcc(spark, folder))


def scc(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.scc(tables.part_graph(spark, folder))


def scc_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.scc(tables.part_graph(spark, folder, 48))


def frontier_expand(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.part_graph(spark, folder)
    return engine.expand(g, spark.createDataFrame([(tables.busiest_source(g),)], "id long"))


def top100(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.first_rows(spmv(spark, folder))


def update_skew(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.update_skew(tables.part_graph(spark, folder).edges, 16).select("lanes_used", "updates", "fullest", F.round("cv", 9).alias("cv"))


def random_weights(spark: SparkSession, folder: str) -> DataFrame:
    return tables.trade_graph(spark, folder).edges.select("src", "dst", text.hashed_weight(1, "src", "dst").alias("weight"))


def slot_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return tables.slot_graph(spark, folder).degrees()


def slot_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.pagerank(tables.slot_graph(spark, folder), 2).selectExpr("id", RANK)


def slot_pagerank10(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.pagerank(tables.slot_graph(spark, folder)).selectExpr("id", RANK)


def slot_pagerank10_supersteps(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.pagerank(tables.slot_graph(spark, folder), in_task=0).selectExpr("id", RANK)


def trade_pagerank10(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.pagerank(tables.trade_graph(spark, folder, None)).selectExpr("id", RANK)


def slot_wcc(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.wcc(tables.slot_graph(spark, folder))


def slot_bfs(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.slot_graph(spark, folder)
    return algorithms.bfs(g, tables.busiest_source(g))


def slot_scc(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.scc(tables.slot_graph(spark, folder))


def slot_desc(spark: SparkSession, folder: str) -> DataFrame:
    return tables.weighted_slot_graph(spark, folder).describe()


def slot_csr_index(spark: SparkSession, folder: str) -> DataFrame:
    return tables.slot_graph(spark, folder).csr_index()


def slot_csc_index(spark: SparkSession, folder: str) -> DataFrame:
    return tables.slot_graph(spark, folder).csc_index()


def slot_self_loops(spark: SparkSession, folder: str) -> DataFrame:
    return tables.slot_graph(spark, folder).edges.where("src = dst").groupBy("src").agg(F.count(F.lit(1)).alias("loops"))


def slot_spmv(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.spmv(tables.weighted_slot_graph(spark, folder))


def slot_top100(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.first_rows(slot_spmv(spark, folder))


def slot_sssp_tree(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.weighted_slot_graph(spark, folder)
    return algorithms.sssp(g, tables.busiest_source(g))


def slot_sssp(spark: SparkSession, folder: str) -> DataFrame:
    return slot_sssp_tree(spark, folder).select("id", "value")


def slot_wcc_count(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.component_count(slot_wcc(spark, folder))


def slot_frontier_expand(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.slot_graph(spark, folder)
    return engine.expand(g, spark.createDataFrame([(tables.busiest_source(g),)], "id long"))


def slot_update_skew(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.update_skew(tables.slot_graph(spark, folder).edges, 16).select("lanes_used", "updates", "fullest", F.round("cv", 9).alias("cv"))


def slot_random_weights(spark: SparkSession, folder: str) -> DataFrame:
    return tables.slot_graph(spark, folder).edges.select("src", "dst", text.hashed_weight(1, "src", "dst").alias("weight"))


def slot_bfs_supersteps(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.slot_graph(spark, folder)
    return algorithms.bfs(g, tables.busiest_source(g), in_task=0)


def slot_sssp_supersteps(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.weighted_slot_graph(spark, folder)
    return algorithms.sssp(g, tables.busiest_source(g), in_task=0).select("id", "value")


def slot_wcc_supersteps(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.wcc(tables.slot_graph(spark, folder), in_task=0)


def slot_scc_supersteps(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.scc(tables.slot_graph(spark, folder), in_task=0)


def bfs_supersteps(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.part_graph(spark, folder)
    return algorithms.bfs(g, tables.busiest_source(g), in_task=0)


def sssp_supersteps(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.part_graph(spark, folder)
    return algorithms.sssp(g, tables.busiest_source(g), in_task=0).select("id", "value")


def pagerank_supersteps(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.pagerank(tables.part_graph(spark, folder), in_task=0).selectExpr("id", RANK)


def wcc_supersteps(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.wcc(tables.part_graph(spark, folder), in_task=0)


def scc_supersteps(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.scc(tables.part_graph(spark, folder), in_task=0)


def spmv_x(spark: SparkSession, folder: str) -> DataFrame:
    """With a vector for two thirds of the ids; the others' values are 1."""
    g = tables.weighted_slot_graph(spark, folder)
    return algorithms.spmv(g, g.vertices().where("id % 3 > 0").select("id", (F.col("id") % 7).cast("double").alias("value")))


def out_edges(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.slot_graph(spark, folder)
    return g.out_edges(g.vertices().where("id % 50 = 0"))


def in_edges(spark: SparkSession, folder: str) -> DataFrame:
    g = tables.slot_graph(spark, folder)
    return g.in_edges(g.vertices().where("id % 50 = 0"))


def user_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return tables.user_graph(spark, folder).degrees()


def user_scc(spark: SparkSession, folder: str) -> DataFrame:
    return algorithms.scc(tables.user_graph(spark, folder), in_task=0)


def _stored(spark: SparkSession, folder: str) -> str:
    """The whole table of edges as a stored graph with in-edges."""
    path = f"{Workspace(spark, 'stored').root}/graph"
    store.save_graph(tables.weighted_slot_graph(spark, folder), path, in_edges=True)
    return path


def stored_edges(spark: SparkSession, folder: str) -> DataFrame:
    return store.load_graph(spark, _stored(spark, folder)).edges


def stored_in_edges(spark: SparkSession, folder: str) -> DataFrame:
    g = store.load_graph(spark, _stored(spark, folder))
    return g.in_edges(g.vertices()).select("src", "dst")


def stored_in_index(spark: SparkSession, folder: str) -> DataFrame:
    return store.load_index(spark, _stored(spark, folder), "dst")


def stored_desc(spark: SparkSession, folder: str) -> DataFrame:
    row = store.read_description(spark, _stored(spark, folder))
    return spark.createDataFrame([tuple(row[k] for k in store.KEYS)], ", ".join(f"{k} long" for k in store.KEYS))


def text_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The table of edges, written as sorted text and read as an edge list."""
    path = f"{Workspace(spark, 'text').root}/edges"
    store.save_sorted_text(tables.slot_graph(spark, folder), path)
    return text.edge_list(spark, path).edges


def adjacency_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The table of edges, written and read as an adjacency list."""
    path = f"{Workspace(spark, 'text').root}/rows"
    store.save_adjacency_text(tables.slot_graph(spark, folder), path)
    return text.adjacency_list(spark, path).edges


def _binary(spark: SparkSession, folder: str) -> Graph:
    g = tables.part_graph(spark, folder, 0)  # all lines
    root = Workspace(spark, "binary").root.removeprefix("file:")
    prefix = f"/{root.lstrip('/')}/graph"
    os.makedirs(os.path.dirname(prefix), exist_ok=True)
    binary.save_binary(g, prefix, in_edges=True)
    return binary.binary_graph(spark, prefix, g.max_id, g.num_edges, True, with_in_edges=True)


def binary_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _binary(spark, folder).edges


def binary_in_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _binary(spark, folder).by_dst.select("src", "dst")


MORE = (
    hierarchy_levels, spmv_x, out_edges, in_edges, user_degrees, user_scc, stored_edges, stored_in_edges, stored_in_index, stored_desc, text_edges, adjacency_edges, binary_edges, binary_in_edges,
)
GRAPH = (
    graph_desc, out_degree, in_degree, csr_index, csc_index, self_loops, spmv, pagerank, pagerank_trade, bfs, sssp, sssp_tree, wcc, wcc_count, scc, scc_sparse,
    frontier_expand, top100, update_skew, random_weights, slot_degrees, slot_pagerank, slot_wcc, slot_bfs, slot_scc,
    slot_desc, slot_csr_index, slot_csc_index, slot_self_loops, slot_spmv, slot_top100, slot_sssp, slot_sssp_tree, slot_wcc_count, slot_frontier_expand,
    slot_update_skew, slot_random_weights, slot_bfs_supersteps, slot_sssp_supersteps, slot_wcc_supersteps, slot_scc_supersteps,
    slot_pagerank10, slot_pagerank10_supersteps, trade_pagerank10,
    bfs_supersteps, sssp_supersteps, pagerank_supersteps, wcc_supersteps, scc_supersteps,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_chains, p1_paths, p1_sizes, p1_full_paths, p1_descendants, p4_found, p4_endpoint_stats, p5_found, p5_edges, *GRAPH, *MORE)}

_P1_TREE = """
WITH RECURSIVE cur AS (
  SELECT id, any_value(CASE WHEN predecessor BETWEEN 0 AND 4294967294 THEN predecessor END) AS p
  FROM sssp_vert_attr s SEMI JOIN (SELECT id, max(superstep) AS superstep FROM sssp_vert_attr GROUP BY id) m USING (id, superstep)
  GROUP BY id),
par AS (SELECT c.id, q.id AS p FROM cur c LEFT JOIN cur q ON c.p = q.id),
down AS (SELECT id, id AS root, 0::BIGINT AS depth FROM par WHERE p IS NULL
  UNION ALL SELECT par.id, down.root, down.depth + 1 FROM down JOIN par ON par.p = down.id),
lost AS (SELECT id, p FROM par ANTI JOIN down USING (id))"""

_P4_ENDS = """WITH ends AS (
  SELECT 'src_vert' AS endpoint, src_vert AS vert, dest_vert AS other FROM tmp_in_edge
  UNION ALL SELECT 'dest_vert', dest_vert, src_vert FROM tmp_in_edge),
ok AS (SELECT endpoint, vert, CASE WHEN other BETWEEN 0 AND 4294967294 THEN other END AS other FROM ends WHERE vert BETWEEN 0 AND 4294967294)"""

_P5 = r"""WITH lines AS (SELECT line_no, raw_line FROM process_edgelist WHERE raw_line IS NULL OR raw_line NOT LIKE '#%'),
parsed AS (SELECT line_no, raw_line,
  regexp_full_match(raw_line, '(?s)[ \t\r]*(("[^"]*"|[^" \t\r]+)([ \t\r]+("[^"]*"|[^" \t\r]+))*)?[ \t\r]*') AS quoted,
  regexp_extract_all(raw_line, '(?s)"[^"]*"|[^" \t\r]+') AS f FROM lines),
bare AS (SELECT line_no, quoted, len(f) AS n,
  CASE WHEN f[1] LIKE '"%' THEN substr(f[1], 2, length(f[1]) - 2) ELSE f[1] END AS a,
  CASE WHEN f[2] LIKE '"%' THEN substr(f[2], 2, length(f[2]) - 2) ELSE f[2] END AS b FROM parsed),
ids AS (SELECT line_no, quoted, n,
  CASE WHEN regexp_full_match(a, '0*[0-9]{1,10}') AND ltrim(a, '0') <= '9999999999' THEN try_cast(a AS HUGEINT) END AS s,
  CASE WHEN regexp_full_match(b, '0*[0-9]{1,10}') THEN try_cast(b AS HUGEINT) END AS d FROM bare),
judged AS (SELECT line_no, s, d, CASE WHEN quoted IS NULL THEN 'column_count' WHEN NOT quoted THEN 'quoting' WHEN n <> 2 THEN 'column_count'
  WHEN s IS NULL OR s > 4294967294 THEN 'src_vert' WHEN d IS NULL OR d > 4294967294 THEN 'dst_vert' END AS reason FROM ids)"""



def _part(quantity: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, b.l_quantity::DOUBLE AS weight FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= {quantity})"""


_TRADE = """WITH RECURSIVE e AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_quantity AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity = 50)"""
_SLOTS = """WITH RECURSIVE e AS (SELECT DISTINCT slot, src, dest_vert AS dst FROM edge WHERE src BETWEEN 0 AND 4294967294 AND dest_vert BETWEEN 0 AND 4294967294)"""
_V = """,
v AS (SELECT range AS id FROM range((SELECT max(greatest(src, dst)) + 1 FROM e)::BIGINT)),
deg AS (SELECT src, count(*) AS d FROM e GROUP BY src), root AS (SELECT src FROM deg ORDER BY d DESC, src LIMIT 1)"""
_BFS = _V + """,
t(id, l) AS (SELECT src, 0 FROM root UNION SELECT e.dst, t.l + 1 FROM t JOIN e ON e.src = t.id WHERE t.l < 60)
SELECT v.id, min(t.l)::BIGINT AS level FROM v LEFT JOIN t USING (id) GROUP BY v.id"""
_WCC = _V + """,
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
t(i, id, c) AS (SELECT 0, id, id FROM v
  UNION ALL SELECT i + 1, id, min(c) FROM (SELECT i, id, c FROM t UNION ALL SELECT t.i, u.b, t.c FROM t JOIN u ON u.a = t.id) WHERE i < 40 GROUP BY i, id)
"""
_SCC = _V + """,
cl(a, b) AS (SELECT id, id FROM v UNION SELECT cl.a, e.dst FROM cl JOIN e ON e.src = cl.b)
SELECT x.a AS id, min(x.b) AS component_root FROM cl x JOIN cl y ON x.a = y.b AND x.b = y.a GROUP BY x.a"""
_INDEX = _V + """,
n AS (SELECT v.id, count(e.src) AS n FROM v LEFT JOIN e ON e.{key} = v.id GROUP BY v.id)
SELECT id, CASE WHEN n = 0 THEN 0 ELSE (sum(n) OVER (ORDER BY id) - n + 1)::BIGINT END AS "offset" FROM n"""
_SPMV = _V + """
SELECT v.id, 1.0::DOUBLE AS origin_value, coalesce(sum(e.weight), 0)::DOUBLE AS spmv_value FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"""


def _rank(iterations: int) -> str:
    return _V + f""",
t(i, id, rk) AS (SELECT 0, id, 1.0::DOUBLE FROM v
  UNION ALL SELECT i + 1, id, sum(x) FROM (SELECT i, id, rk AS x FROM t
    UNION ALL SELECT t.i, e.dst, 0.85::DOUBLE * (t.rk / deg.d) + 0.15::DOUBLE FROM t JOIN e ON e.src = t.id JOIN deg ON deg.src = t.id) WHERE i < {iterations} GROUP BY i, id)
SELECT id, rk::FLOAT::DOUBLE AS rank FROM t WHERE i = {iterations}"""


SQL: dict[str, str] = {
    "graph_desc": _part(46) + _V + """ SELECT min(least(src, dst)) AS min_vertex_id, max(greatest(src, dst)) AS max_vertex_id, count(*) AS num_of_edges,
  (SELECT max(d) FROM deg) AS max_out_edges, 1::INTEGER AS edge_type, 1::INTEGER AS with_in_edge FROM e""",
    "out_degree": _part(46) + _V + " SELECT v.id, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id",
    "in_degree": _part(46) + _V + " SELECT v.id, count(e.src) AS in_degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id",
    "csr_index": _part(46) + _INDEX.format(key="src"),
    "csc_index": _part(46) + _INDEX.format(key="dst"),
    "self_loops": _TRADE + " SELECT src::BIGINT AS src, count(*) AS loops FROM e WHERE src = dst GROUP BY src",
    "spmv": _part(46) + _SPMV,
    "top100": _part(46) + _SPMV + " ORDER BY v.id LIMIT 100",
    "pagerank": _part(46) + _rank(10),
    "pagerank_trade": _TRADE + _rank(3),
    "slot_pagerank": _SLOTS + _rank(2),
    "bfs": _part(46) + _BFS,
    "slot_bfs": _SLOTS + _BFS,
    "sssp": _part(46) + _V + """,
t(i, id, d) AS (SELECT 0, src, 0::DOUBLE FROM root
  UNION ALL SELECT i + 1, id, min(d) FROM (SELECT i, id, d FROM t UNION ALL SELECT t.i, e.dst, t.d + e.weight FROM t JOIN e ON e.src = t.id AND e.src <> e.dst) WHERE i < 60 GROUP BY i, id)
SELECT v.id, coalesce(t.d, 'Infinity'::DOUBLE) AS value FROM v LEFT JOIN t ON t.id = v.id AND t.i = 60""",
    "wcc": _part(46) + _WCC + " SELECT id, c AS component_root FROM t WHERE i = 40",
    "wcc_count": _part(46) + _WCC + " SELECT count(*) AS components FROM t WHERE i = 40 AND id = c",
    "slot_wcc": _SLOTS + _WCC + " SELECT id, c AS component_root FROM t WHERE i = 40",
    "scc": _part(46) + _SCC,
    "scc_sparse": _part(48) + _SCC,
    "frontier_expand": _part(46) + _V + " SELECT dst AS id, count(*) AS messages FROM e WHERE src = (SELECT src FROM root) AND src <> dst GROUP BY dst",
    "update_skew": _part(46) + """, n AS (SELECT l.range AS lane, count(e.dst) AS n FROM range(16) l LEFT JOIN e ON e.dst % 16 = l.range GROUP BY l.range)
SELECT sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS lanes_used, sum(n)::BIGINT AS updates, max(n) AS fullest, round(stddev_pop(n) / avg(n), 9) AS cv FROM n""",
    "slot_degrees": _SLOTS + _V + """, i AS (SELECT dst, count(*) AS n FROM e GROUP BY dst)
SELECT v.id, coalesce(deg.d, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM v LEFT JOIN deg ON deg.src = v.id LEFT JOIN i ON i.dst = v.id""",
    "p1_found": _P1_TREE + """,
walk AS (SELECT id AS start, p AS stop FROM lost
  UNION SELECT walk.start, lost.p FROM walk JOIN lost ON walk.stop = lost.id),
on_loop AS (SELECT start AS id FROM walk WHERE start = stop),
behind AS (SELECT w.start AS id, min(w.stop) AS root FROM walk w JOIN on_loop o ON w.stop = o.id GROUP BY w.start)
SELECT id, root, depth FROM down UNION ALL SELECT id, root, -1::BIGINT FROM behind""",
    "p1_sizes": _P1_TREE + """,
up AS (SELECT id AS low, id AS anc FROM down UNION ALL SELECT up.low, par.p FROM up JOIN par ON up.anc = par.id WHERE par.p IS NOT NULL),
n AS (SELECT anc AS id, count(*) AS nodes_below_and_self FROM up GROUP BY anc)
SELECT id, root, depth, nodes_below_and_self FROM down JOIN n USING (id)""",
    "p4_found": _P4_ENDS + " SELECT endpoint, vert FROM ok GROUP BY endpoint, vert HAVING count(*) * 50 >= (SELECT count(*) FROM ok o WHERE o.endpoint = ok.endpoint)",
    "p4_endpoint_stats": _P4_ENDS + " SELECT endpoint, vert, count(*) AS degree, count(DISTINCT other) AS distinct_neighbours, min(other) AS smallest_neighbour FROM ok GROUP BY endpoint, vert",
    "p5_found": _P5 + " SELECT line_no, reason FROM judged WHERE reason IS NOT NULL",
    "p5_edges": _P5 + " SELECT line_no, s::BIGINT AS src_vert, d::BIGINT AS dst_vert FROM judged WHERE reason IS NULL",
}
# The same queries without the one-task kernels.
SQL |= {f"{name}_supersteps": SQL[name] for name in ("bfs", "sssp", "pagerank", "wcc", "scc")}

# The whole table of edges, for what runs on a filtered lineitem above. A weight that is NULL, NaN or negative is none.
_WEIGHTS = """WITH RECURSIVE e AS (SELECT slot, src, dest_vert AS dst, max(CASE WHEN weight >= 0 AND NOT isnan(weight) THEN weight END)::DOUBLE AS weight FROM edge
  WHERE src BETWEEN 0 AND 4294967294 AND dest_vert BETWEEN 0 AND 4294967294 GROUP BY slot, src, dest_vert)"""
SQL |= {
    "slot_desc": _WEIGHTS + SQL["graph_desc"].removeprefix(_part(46)),
    "slot_csr_index": _SLOTS + _INDEX.format(key="src"),
    "slot_csc_index": _SLOTS + _INDEX.format(key="dst"),
    "slot_self_loops": _SLOTS + SQL["self_loops"].removeprefix(_TRADE),
    "slot_spmv": _WEIGHTS + _SPMV,
    "slot_top100": _WEIGHTS + _SPMV + " ORDER BY v.id LIMIT 100",
    # Weights are fractions here, so the rule that an improvement below 0.001 is none counts, and with it who is active.
    "slot_sssp": _WEIGHTS + _V + """,
t(i, id, d, active) AS (SELECT 0, src, 0::DOUBLE, true FROM root
  UNION ALL SELECT i, id, CASE WHEN ok THEN m ELSE d END, ok FROM (SELECT *, m IS NOT NULL AND m < d AND (d = 'Infinity'::DOUBLE OR abs(m - d) >= 1e-3::DOUBLE) AS ok FROM (
    SELECT i + 1 AS i, id, coalesce(min(d), 'Infinity'::DOUBLE) AS d, min(m) AS m FROM (SELECT i, id, d, NULL::DOUBLE AS m FROM t
      UNION ALL SELECT t.i, e.dst, NULL::DOUBLE, t.d + e.weight FROM t JOIN e ON e.src = t.id AND e.src <> e.dst WHERE t.active AND e.weight IS NOT NULL) WHERE i < 60 GROUP BY i, id)))
SELECT v.id, coalesce(t.d, 'Infinity'::DOUBLE) AS value FROM v LEFT JOIN t ON t.id = v.id AND t.i = 60""",
    # With the default number of iterations, over all edges and all lines.
    "slot_pagerank10": _SLOTS + _rank(10),
    "trade_pagerank10": _TRADE.replace(" WHERE l_quantity = 50", "") + _rank(10),
    "slot_wcc_count": _SLOTS + _WCC + " SELECT count(*) AS components FROM t WHERE i = 40 AND id = c",
    "slot_frontier_expand": _SLOTS + SQL["frontier_expand"].removeprefix(_part(46)),
    "slot_update_skew": _SLOTS + SQL["update_skew"].removeprefix(_part(46)),
}
SQL |= {f"slot_{name}_supersteps": SQL[f"slot_{name}"] for name in ("bfs", "sssp", "wcc", "pagerank10")}

# The whole trees: sizes by all pairs of a node and one above it, places by a walk from the roots.
_P1_LOOPS = """,
walk AS (SELECT id AS start, p AS stop FROM lost
  UNION SELECT walk.start, lost.p FROM walk JOIN lost ON walk.stop = lost.id),
on_loop AS (SELECT start AS id FROM walk WHERE start = stop),
behind AS (SELECT w.start AS id, min(w.stop) AS root FROM walk w JOIN on_loop o ON w.stop = o.id GROUP BY w.start)"""
_P1_PLACES = _P1_TREE + _P1_LOOPS + """,
up AS (SELECT id AS low, id AS anc FROM down UNION ALL SELECT up.low, par.p FROM up JOIN par ON up.anc = par.id WHERE par.p IS NOT NULL),
n AS (SELECT anc AS id, count(*) AS size FROM up GROUP BY anc),
kids AS (SELECT par.id, par.p, n.size, ((par.id % 2147483648) * 2654435761) % 4294967296 AS o FROM par JOIN n USING (id) WHERE par.p IS NOT NULL),
placed AS (SELECT id, p, coalesce(sum(size) OVER (PARTITION BY p ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  row_number() OVER (PARTITION BY p ORDER BY size DESC, id) = 1 AS heavy FROM kids),
spot(id, pre, chain, pos) AS (SELECT id, 1::BIGINT, id, 0::BIGINT FROM down WHERE depth = 0
  UNION ALL SELECT k.id, spot.pre + 1 + k.before, CASE WHEN heavy THEN spot.chain ELSE k.id END, CASE WHEN heavy THEN spot.pos + 1 ELSE 0 END FROM spot JOIN placed k ON k.p = spot.id),
nodes AS (SELECT d.id, par.p AS parent, d.root, d.depth, n.size, spot.pre, spot.chain, spot.pos FROM down d JOIN par USING (id) JOIN n USING (id) JOIN spot USING (id))"""
_P1_UP = _P1_TREE + """,
asked AS (SELECT id FROM down WHERE id % 50 = 0),
up(id, node, hop) AS (SELECT id, id, 0 FROM asked UNION ALL SELECT up.id, par.p, hop + 1 FROM up JOIN par ON up.node = par.id WHERE par.p IS NOT NULL)"""
SQL |= {
    "p1_hierarchy": _P1_PLACES + """
SELECT id, parent, root, depth, size, pre, chain, pos FROM nodes
UNION ALL SELECT b.id, par.p, b.root, -1::BIGINT, NULL, NULL, NULL, NULL FROM behind b JOIN par USING (id)""",
    "p1_chains": _P1_PLACES + """
SELECT chain, pos // 4096 AS block_no, max(CASE WHEN id = chain THEN parent END) AS attach, string_agg(id, '>' ORDER BY pos) AS members FROM nodes GROUP BY chain, pos // 4096""",
    "p1_paths": _P1_PLACES + """,
hop(chain, before) AS (SELECT id, '' FROM nodes WHERE pos = 0 AND parent IS NULL
  UNION ALL SELECT t.id, hop.before || p.chain || ':' || p.pos || '>' FROM hop JOIN nodes p ON p.chain = hop.chain JOIN nodes t ON t.parent = p.id AND t.pos = 0)
SELECT id, root, depth, before || chain || ':' || pos AS hops FROM nodes JOIN hop USING (chain)""",
    "p1_full_paths": _P1_UP + " SELECT id, string_agg(node, '>' ORDER BY hop DESC) AS path FROM up GROUP BY id",
    "p1_descendants": _P1_TREE + """,
below(id, below) AS (SELECT p, id FROM par JOIN down USING (id) WHERE p IS NOT NULL AND p % 50 = 0
  UNION ALL SELECT below.id, par.id FROM below JOIN par ON par.p = below.below) SELECT id, below FROM below""",
    "hierarchy_levels": SQL["p1_found"],
    "spmv_x": _WEIGHTS + _V + """, x AS (SELECT id, CASE WHEN id % 3 > 0 THEN (id % 7)::DOUBLE ELSE 1 END AS x FROM v)
SELECT x.id, x.x AS origin_value, coalesce(s.s, 0)::DOUBLE AS spmv_value FROM x LEFT JOIN (SELECT dst, sum(e.weight * x.x) AS s FROM e JOIN x ON x.id = e.src GROUP BY dst) s ON s.dst = x.id""",
    "out_edges": _SLOTS + " SELECT src, dst FROM e WHERE src % 50 = 0",
    "in_edges": _SLOTS + " SELECT src, dst FROM e WHERE dst % 50 = 0",
    "stored_edges": _WEIGHTS + " SELECT src, dst, weight FROM e",
    "stored_in_edges": _SLOTS + " SELECT src, dst FROM e",
    "stored_in_index": _SLOTS + _INDEX.format(key="dst"),
    "stored_desc": _SLOTS + _V + """ SELECT min(least(src, dst)) AS min_vertex_id, max(greatest(src, dst)) AS max_vertex_id, count(*) AS num_of_edges,
  (SELECT max(d) FROM deg) AS max_out_edges, 1::BIGINT AS edge_type, 1::BIGINT AS with_in_edge FROM e""",
    "text_edges": _SLOTS + " SELECT src, dst FROM e",
    "adjacency_edges": _SLOTS + " SELECT src, dst FROM e",
    "binary_edges": _part(0) + " SELECT src, dst, weight FROM e",
    "binary_in_edges": _part(0) + " SELECT src, dst FROM e",
}
_USERS = """WITH RECURSIVE e AS (SELECT user_id AS src, next AS dst FROM (SELECT *, lead(user_id) OVER (ORDER BY ts, event_id) AS next FROM events) WHERE event_type = 'error' AND next IS NOT NULL)"""
SQL |= {"user_degrees": _USERS + SQL["slot_degrees"].removeprefix(_SLOTS), "user_scc": _USERS + _SCC}

# Distances with predecessors, superstep by superstep: of equal distances that arrive together the smallest sender, and none that arrives later.
_TREE = _V + """,
t(i, id, d, p, active) AS (SELECT 0, src, 0::DOUBLE, NULL::BIGINT, true FROM root
  UNION ALL SELECT i, id, CASE WHEN ok THEN m.v ELSE d END, CASE WHEN ok THEN m.p ELSE p END, ok FROM (SELECT *, m IS NOT NULL AND m.v < d AND (d = 'Infinity'::DOUBLE OR abs(m.v - d) >= 1e-3::DOUBLE) AS ok FROM (
    SELECT i + 1 AS i, id, coalesce(min(d), 'Infinity'::DOUBLE) AS d, max(p) AS p, min(m) AS m FROM (SELECT i, id, d, p, NULL::STRUCT(v DOUBLE, p BIGINT) AS m FROM t
      UNION ALL SELECT t.i, e.dst, NULL, NULL, {'v': t.d + e.weight, 'p': t.id} FROM t JOIN e ON e.src = t.id AND e.src <> e.dst WHERE t.active AND e.weight IS NOT NULL) WHERE i < 60 GROUP BY i, id)))
SELECT v.id, t.p AS predecessor, coalesce(t.d, 'Infinity'::DOUBLE) AS value FROM v LEFT JOIN t ON t.id = v.id AND t.i = 60"""
# The component of the busiest source by reaching it and being reached; what is left, without vertices that nothing enters or leaves, by closure.
_WHOLE_SCC = _V + """,
ahead(id) AS (SELECT src FROM root UNION SELECT e.dst FROM ahead JOIN e ON e.src = ahead.id),
before(id) AS (SELECT src FROM root UNION SELECT e.src FROM before JOIN e ON e.dst = before.id),
core AS (SELECT id FROM ahead SEMI JOIN before USING (id)),
r AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst AND src NOT IN (SELECT id FROM core) AND dst NOT IN (SELECT id FROM core)),
q AS (SELECT * FROM r WHERE src IN (SELECT dst FROM r) AND dst IN (SELECT src FROM r)),
cl(a, b) AS (SELECT src, dst FROM q UNION SELECT cl.a, q.dst FROM cl JOIN q ON q.src = cl.b),
s AS (SELECT id, (SELECT min(id) FROM core) AS c FROM core UNION ALL SELECT x.a, min(x.b) FROM cl x JOIN cl y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT v.id, least(v.id, coalesce(s.c, v.id)) AS component_root FROM v LEFT JOIN s USING (id)"""


def _drawn(edges: str, seed: int) -> str:
    """Weights drawn as ``text.hashed_weight`` does: for each end, its value and 1 in turn."""
    h = str(seed)
    for c in ("src", "1", "dst", "1"):
        h = f"(({h}) * 48271 + {c} % 2147483647) % 2147483647"
    return f"{edges} SELECT src, dst, ((({h}) * 48271) % 2147483647) % 10000 / 1000.0::DOUBLE AS weight FROM (SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM e)"


SQL |= {
    "sssp_tree": _part(46) + _TREE, "slot_sssp_tree": _WEIGHTS + _TREE, "slot_scc": _SLOTS + _WHOLE_SCC, "slot_scc_supersteps": _SLOTS + _WHOLE_SCC,
    "random_weights": _drawn(_TRADE, 1), "slot_random_weights": _drawn(_SLOTS, 1),
}
