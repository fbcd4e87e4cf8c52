"""Graphs and results on storage: Parquet edges clustered by source, an INI description, offset indexes, result tables."""

from __future__ import annotations

import configparser
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.vertex_ids import export_sentinel
from vertexloom.operators.graph import Graph
from vertexloom.plans.sizing import parts

EDGES_PER_FILE = 20_000_000
# Fixed names of the description's section and keys.
SECTION = "description"
KEYS = ("min_vertex_id", "max_vertex_id", "num_of_edges", "max_out_edges", "edge_type", "with_in_edge")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no graph description at {path}")
    return "\n".join(r["value"] for r in spark.read.text(path).collect())  # a handful of lines


def save_graph(graph: Graph, folder: str, in_edges: bool = False) -> dict[str, int]:
    """Write ``edges``, ``index`` and, if asked, ``in_edges`` and ``in_index``, and the description; returns the description.

    Edges are range-partitioned and sorted by their key, so that a reader of a few vertices skips the other files and pages.
    """
    spark = graph.spark
    n = parts(max(1, graph.num_edges if graph.num_edges is not None else graph.edges.count()), EDGES_PER_FILE)
    rest = ["weight"] if graph.weighted else []

    def sorted_by(key: str, *cols: str) -> DataFrame:
        return graph.edges.repartitionByRange(n, key).sortWithinPartitions(key).select(*cols)

    sorted_by("src", "src", "dst", *rest).write.mode("overwrite").parquet(f"{folder}/edges")
    graph.csr_index().write.mode("overwrite").parquet(f"{folder}/index")
    if in_edges:
        sorted_by("dst", "dst", "src").write.mode("overwrite").parquet(f"{folder}/in_edges")
        graph.csc_index().write.mode("overwrite").parquet(f"{folder}/in_index")
    row = graph.describe().first().asDict() | {"with_in_edge": int(in_edges)}
    # The dense domain may reach beyond the last edge.
    row["max_vertex_id"] = graph.max_id
    described = {k: int(row[k]) if row[k] is not None else 0 for k in KEYS}
    ini = configparser.ConfigParser()
    ini[SECTION] = {k: str(v) for k, v in described.items()}
    text = io.StringIO()
    ini.write(text)
    _write_text(spark, f"{folder}/graph.desc", text.getvalue())
    return described


def read_description(spark: SparkSession, folder: str) -> dict[str, int]:
    """The description of a saved graph; a missing or incomplete one is an error."""
    ini = configparser.ConfigParser()
    ini.read_string(_read_text(spark, f"{folder}/graph.desc"))
    missing = [k for k in KEYS if not ini.has_option(SECTION, k)]
    if missing:
        raise ValueError(f"the description of {folder} lacks {', '.join(missing)}")
    return {k: ini.getint(SECTION, k) for k in KEYS}


def load_graph(spark: SparkSession, folder: str) -> Graph:
    """A saved graph, without a pass over its edges: the description has the sizes. Stored in-edges are used by what needs them."""
    d = read_description(spark, folder)
    by_dst = spark.read.parquet(f"{folder}/in_edges") if d["with_in_edge"] == 1 else None
    return Graph(spark.read.parquet(f"{folder}/edges"), d["max_vertex_id"], d["edge_type"] == 1, d["with_in_edge"] == 1, d["num_of_edges"], by_dst)


def load_index(spark: SparkSession, folder: str, of: str = "src") -> DataFrame:
    """The stored ``(id, offset)`` of the edges by source, or of the in-edges by destination."""
    return spark.read.parquet(f"{folder}/{'index' if of == 'src' else 'in_index'}")


def save_adjacency_text(graph: Graph, path: str) -> None:
    """A line ``src n dst1 ... dstn`` for each vertex with out-edges: a line is as long as its vertex has edges."""
    rows = graph.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("d"))
    rows.select(F.concat_ws(" ", F.col("src").cast("string"), F.size("d").cast("string"), F.transform("d", lambda x: x.cast("string"))).alias("value")).write.mode("overwrite").text(path)


def save_result(result: DataFrame, path: str, sentinels: bool = False) -> None:
    """Write a result, one row for every vertex, sorted by id; with ``sentinels``, whole-number NULLs become 4294967295."""
    if sentinels:
        result = result.select(*[export_sentinel(c).alias(c) if t == "bigint" else F.col(c) for c, t in result.dtypes])
    result.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def save_sorted_text(graph: Graph, path: str, key: str = "src") -> None:
    """The edges as tab-separated text, globally in order of ``key``."""
    cols = ["src", "dst", *(["weight"] if graph.weighted else [])]
    graph.edges.orderBy(key).select(F.concat_ws("\t", *cols).alias("value")).write.mode("overwrite").text(path)
