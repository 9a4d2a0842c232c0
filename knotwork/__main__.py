"""python -m knotwork stats EDGES [--weighted] | community EDGES [TRUTH] [--algo louvain|leiden] [--louvain] [--leiden] [--weighted] [--bench DIR]"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import detect, index, metrics, moves
from .operators.graph import Graph
from .sources import edgelist


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="knotwork")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("stats", "community"):
        sub = commands.add_parser(name)
        sub.add_argument("edges")
        sub.add_argument("--weighted", action="store_true")
        if name == "community":
            sub.add_argument("truth", nargs="?")
            sub.add_argument("--algo", choices=("louvain", "leiden"), default="louvain")
            for algo in ("louvain", "leiden"):
                sub.add_argument(f"--{algo}", dest="algo", action="store_const", const=algo)
            sub.add_argument("--resolution", type=float, default=1.0)
            sub.add_argument("--bench")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("knotwork").getOrCreate()
    graph = Graph(edgelist.read_edge_list(spark, args.edges, args.weighted))
    if args.command == "stats":
        graph.summary().show(truncate=False)
        graph.memory_model().show(truncate=False)
        graph.log2_histogram().orderBy("bucket").show(40)
        return
    began = time.perf_counter()
    hierarchy = detect.detect(graph, args.algo, args.resolution)
    found = detect.last_level(hierarchy)
    repaired = moves.enforce_connectivity(graph, found)
    count = repaired.agg(F.countDistinct("c")).first()[0]
    took = 1000 * (time.perf_counter() - began)
    splits = moves.connectivity_splits(graph, found).first()[0]
    score = metrics.modularity(graph, repaired).first()[0]
    truth = args.truth and edgelist.read_truth(spark, args.truth, graph.vertices)
    nmi = metrics.nmi(repaired, truth).first()[0] if truth else None
    size = graph.summary().first()
    row = (args.algo, args.edges, size.nodes, size.edges, count, splits, score, nmi, took)
    spark.createDataFrame([row], edgelist.BENCH_SCHEMA).show(truncate=False)
    index.CommunityIndex(graph, repaired, hierarchy).demo().show(truncate=False)
    if args.bench:
        edgelist.append_bench_row(spark, args.bench, row)


if __name__ == "__main__":
    main()
