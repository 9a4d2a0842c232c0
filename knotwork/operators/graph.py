"""Undirected weighted multigraphs as DataFrames, and their profile."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import sum_before


class Graph:
    """``edges`` (src, dst, w), one row per undirected edge; loops count twice in degrees.

    ``count`` fixes the id space 0..count-1; without it the space ends at the
    largest id. Without edges there are no vertices.
    """

    def __init__(self, edges: DataFrame, count: int | None = None):
        self.edges = edges.select("src", "dst", "w")
        self._count = count

    @cached_property
    def n(self) -> int:
        top = self.edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        n = 0 if top is None else top + 1
        if self._count is not None:
            if n > self._count:
                raise ValueError("edge endpoint out of range")
            return self._count
        return n

    @property
    def adj(self) -> DataFrame:
        """Both directions of every edge."""
        return self.edges.unionAll(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))

    @cached_property
    def vertices(self) -> DataFrame:
        """``v, deg, k`` of the whole id space."""
        degrees = self.adj.groupBy("src").agg(F.count(F.lit(1)).alias("deg"), F.sum("w").alias("k"))
        ids = self.edges.sparkSession.range(self.n).select(F.col("id").alias("v"))
        zero = F.lit(0).cast(dict(degrees.dtypes)["k"])
        return ids.join(degrees, F.col("v") == F.col("src"), "left").select(
            "v", F.coalesce("deg", F.lit(0)).alias("deg"), F.coalesce("k", zero).alias("k")
        )

    def neighbors(self, v: int) -> DataFrame:
        return self.adj.filter(F.col("src") == v).select("dst", "w")

    def offsets(self) -> DataFrame:
        """Where each vertex's neighbours begin if they are laid out by vertex."""
        return sum_before(self.vertices, "v", F.col("deg"), "start").select("v", "start")

    def summary(self) -> DataFrame:
        return self.vertices.agg(
            F.count(F.lit(1)).alias("nodes"),
            F.floor(F.sum("deg") / 2).alias("edges"),
            F.round(F.sum("deg") / F.count(F.lit(1)), 9).alias("avg_degree"),
            F.max("deg").alias("max_degree"),
            F.sum((F.col("deg") == 0).cast("long")).alias("isolated"),
            F.round(F.sum("k") / 2, 9).alias("total_weight"),
        )

    def memory_model(self) -> DataFrame:
        """Bytes of a compressed sparse row layout, per edge and per slot."""
        n, m = F.col("nodes"), F.col("edges")
        size = 8 * (n + 1) + 4 * 2 * m + 8 * 2 * m + 8 * n
        return self.summary().select(
            size.alias("bytes"),
            F.round(F.try_divide(size, m), 9).alias("bytes_per_edge"),
            F.round(F.try_divide(size, 2 * m), 9).alias("bytes_per_slot"),
        )

    def log2_histogram(self) -> DataFrame:
        """Vertices by power of two of their degree; ``low`` is the bucket's least degree."""
        bucket = F.when(F.col("deg") == 0, 0).otherwise(F.least(F.length(F.bin("deg")), F.lit(33)))
        counted = self.vertices.groupBy(bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        low = F.when(F.col("bucket") == 0, 0).otherwise(F.pow(F.lit(2), F.col("bucket") - 1)).cast("long")
        return counted.select("bucket", low.alias("low"), "n")

    def simplify(self) -> DataFrame:
        """Parallel edges summed, loops dropped."""
        return (
            self.edges.filter("src <> dst")
            .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .agg(F.sum("w").alias("w"))
        )
