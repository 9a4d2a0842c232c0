"""Longest distances from the sources of a directed acyclic graph, without a round a level.

Nodes with a single incoming arc hang on their predecessor, so chains and trees are
contracted at once: pointer jumping doubles how far each such node sees until its
anchor has several incoming arcs or is the root that stands for all nodes of known
level. Arcs of contracted nodes move to their anchors, the longest of parallel ones
stays, and nodes whose predecessors were all known now have one arc, from the root.
Rounds follow how often paths of different length meet, not how long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize_at

#: Stands for every node whose level is known; no node may have this id.
ROOT = -(1 << 63)


def _anchored(single: DataFrame) -> tuple[DataFrame, str, int]:
    """``x, anchor, dist`` with anchors that are not in ``single`` themselves, its path, and the rounds it took."""
    spark = single.sparkSession
    now, path = materialize_at(single.withColumn("open", F.lit(True)), "anchors")
    most, rounds = now.count().bit_length() + 1, 0
    while True:
        far = now.select(F.col("x").alias("anchor"), F.col("anchor").alias("a"), F.col("dist").alias("d"))
        joined = now.join(far, "anchor", "left")
        ahead = joined.select("x", F.coalesce("a", "anchor").alias("anchor"), (F.col("dist") + F.coalesce("d", F.lit(0))).alias("dist"), F.col("a").isNotNull().alias("open"))
        following, following_path = materialize_at(ahead, "anchors")
        discard(spark, path)
        now, path, rounds = following, following_path, rounds + 1
        if now.filter("open").isEmpty():
            return now.select("x", "anchor", "dist"), path, rounds
        if rounds > most:  # a chain of all of them would have ended
            raise ValueError("the graph has a cycle")


def topo_levels(arcs: DataFrame) -> DataFrame:
    """``node, level``: the longest distance from a source; raises ValueError on a cycle.

    Repeated arcs count once, null ends are left out.
    """
    return _levels(arcs)[0]


def _levels(arcs: DataFrame) -> tuple[DataFrame, int]:
    """The levels, and how many rounds of jumping and contracting they took."""
    spark = arcs.sparkSession
    whole, whole_path = materialize_at(arcs.select("src", "dst").filter("src is not null and dst is not null").distinct(), "arcs")
    sources = whole.select(F.col("src").alias("node")).distinct().join(whole.select(F.col("dst").alias("node")), "node", "left_anti")
    found, found_path = materialize_at(sources.select("node", F.lit(0).cast("long").alias("level")), "levels")
    start = whole.join(found.select(F.col("node").alias("src"), "level"), "src", "left")
    start = start.select(F.when(F.col("level").isNotNull(), F.lit(ROOT)).otherwise(F.col("src")).alias("src"), "dst", F.lit(1).cast("long").alias("w"))
    left, left_path = materialize_at(start.distinct(), "arcs-left")
    discard(spark, whole_path)
    steps, rounds = [], 0
    while not left.isEmpty():
        degrees = left.groupBy(F.col("dst").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("anchor"), F.min("w").alias("dist"))
        single, single_path = materialize_at(degrees.filter("n = 1").drop("n"), "single")
        if single.isEmpty():
            raise ValueError("the graph has a cycle")
        hung, hung_path, took = _anchored(single)
        rounds += took + 1
        discard(spark, single_path)
        steps.append((hung, hung_path))
        others = left.join(hung.select(F.col("x").alias("dst")), "dst", "left_anti")
        moved = others.join(hung.select(F.col("x").alias("src"), "anchor", "dist"), "src", "left")
        moved = moved.select(F.coalesce("anchor", "src").alias("src"), "dst", (F.col("w") + F.coalesce("dist", F.lit(0))).alias("w"))
        following, following_path = materialize_at(moved.groupBy("src", "dst").agg(F.max("w").alias("w")), "arcs-left")
        discard(spark, left_path)
        left, left_path = following, following_path
    discard(spark, left_path)
    for hung, path in reversed(steps):  # anchors were contracted later or are the root
        direct = hung.filter(F.col("anchor") == ROOT).select(F.col("x").alias("node"), F.col("dist").alias("level"))
        known = spark.read.schema(found.schema).parquet(found_path).select(F.col("node").alias("anchor"), "level")
        behind = hung.filter(F.col("anchor") != ROOT).join(known, "anchor").select(F.col("x").alias("node"), (F.col("dist") + F.col("level")).alias("level"))
        direct.unionByName(behind).write.mode("append").parquet(found_path)
        discard(spark, path)
    return spark.read.schema(found.schema).parquet(found_path), rounds
