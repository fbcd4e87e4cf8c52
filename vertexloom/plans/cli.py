"""``python -m vertexloom convert`` and ``run``."""

from __future__ import annotations

import argparse
import logging
import os
import time

from vertexloom.operators import algorithms
from vertexloom.plans import registry
from vertexloom.plans.session import session
from vertexloom.sources import store, text

log = logging.getLogger("vertexloom")


def _flag(value: str) -> bool:
    if value.lower() in ("1", "true", "yes"):
        return True
    if value.lower() in ("0", "false", "no"):
        return False
    raise argparse.ArgumentTypeError(f"neither true nor false: {value}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vertexloom")
    todo = top.add_subparsers(dest="command", required=True)
    convert = todo.add_parser("convert", help="a text graph to a stored graph")
    convert.add_argument("-g", "--graph", required=True)
    convert.add_argument("-t", "--type", required=True, choices=["edgelist", "adjlist"])
    convert.add_argument("-d", "--destination", required=True)
    convert.add_argument("-o", "--out-type", required=True, help="type1: weighted; anything else: unweighted")
    convert.add_argument("-i", "--in-edge", type=_flag, default=False)
    convert.add_argument("--seed", type=int, default=0, help="of the weights that are drawn")
    run = todo.add_parser("run", help="an algorithm on a stored graph")
    run.add_argument("-g", "--graph", required=True, help="the folder that convert wrote")
    run.add_argument("-a", "--application", required=True, help=", ".join(registry.names()))
    run.add_argument("-i", "--in-edge", type=_flag, default=None, help="use in-edges; default: if the graph has them")
    run.add_argument("-d", "--destination", help="where the result is written")
    run.add_argument("-m", "--memory", type=int, help="MB of the driver, in local mode")
    run.add_argument("-p", "--processors", type=int, help="local cores, where no master is set")
    run.add_argument("--log-file", help="also log to this file; by default print-<application>-<time>.log in --log-folder, if that is given")
    run.add_argument("--log-folder")
    run.add_argument("--niters", "--pagerank::niters", type=int)
    run.add_argument("--source", "--sssp::source", type=int)
    run.add_argument("--bfs-root", "--bfs::bfs-root", type=int)
    return top


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    args = parser().parse_args(argv)
    if args.command == "run" and (args.log_file or args.log_folder):
        name = args.log_file or os.path.join(args.log_folder, f"print-{args.application}-{time.strftime('%Y%m%d-%H%M%S')}.log")
        log.addHandler(logging.FileHandler(name))
    settings = {}
    if args.command == "run" and args.memory:
        settings["spark__driver__memory"] = f"{args.memory}m"
    if args.command == "run" and args.processors:
        settings["spark__master"] = f"local[{args.processors}]"
    spark = session(**settings)
    began = time.perf_counter()
    if args.command == "convert":
        read = text.edge_list if args.type == "edgelist" else text.adjacency_list
        graph = read(spark, args.graph, weighted=args.out_type == "type1", seed=args.seed)
        log.info("description: %s", store.save_graph(graph, args.destination, args.in_edge))
    else:
        graph = store.load_graph(spark, args.graph)
        if args.in_edge and not graph.with_in_edges:
            raise ValueError("the graph was converted without in-edges")
        # cc, scc, ... take the options they know.
        options = {k: v for k in ("niters", "source", "bfs_root") if (v := getattr(args, k)) is not None}
        result = registry.run(args.application, graph, **options)
        if args.destination:
            store.save_result(result, args.destination)
            result = spark.read.parquet(args.destination)
        for row in algorithms.first_rows(result).collect():
            log.info("%s", row.asDict())
        if args.application == "cc":
            log.info("components: %d", algorithms.component_count(result).first()[0])
    log.info("run time = %.1f seconds", time.perf_counter() - began)
    return 0
