"""Connected components by alternating star contractions.

Each round joins edges with the smallest neighbour of one endpoint (a partial
aggregate, so vertices of any degree are safe) and is written to the shared
folder. Vertices that hold more than one part in ``PARTS`` of all edge ends -
``PARTS`` of them at most - meet their neighbour by broadcast, so the shuffled
rest has no hot key. The edge set shrinks towards one star per component, whose
centre is its smallest vertex, in O(log^2 n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize_at

MOST_ROUNDS = 60
PARTS = 64


def _settled(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are stars: no vertex has two parents, or a parent and a child."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select("v", F.lit(0), F.lit(1))
    )
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = per.agg(
        F.coalesce(F.sum("up"), F.lit(0)),
        F.coalesce(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))), F.lit(False)),
    ).first()
    return row[0], not row[1]


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """``u, v, m`` with the smallest ``v`` of each ``u`` (or ``u`` itself) as ``m``; n: the number of edges."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    least = least.select("u", F.least("u", "m").alias("m"), "c")
    hot = F.broadcast(least.filter(F.col("c") > F.lit(2 * n / PARTS)).select("u", "m"))
    rest = rows.join(hot.select("u"), "u", "left_anti").join(least.select("u", "m"), "u")
    return rows.join(hot, "u").select("u", "v", "m").unionAll(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    small = _with_least(edges, n)
    moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(small.select("u", F.col("m").alias("v"))).distinct()


def star_forest(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``v, root`` for every vertex of ``edges`` that is not its component's smallest.

    Loops and repeated edges are harmless; null endpoints are left out.
    """
    spark = edges.sparkSession
    start = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    now, path = materialize_at(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    for _ in range(MOST_ROUNDS):
        n, done = _settled(now)
        if done:
            break
        # written in between: one plan of both steps would repeat the first in each branch of the second
        large, large_path = materialize_at(_large_star(now, n), "star")
        discard(spark, path)
        following, new_path = materialize_at(_small_star(large, n), "star")
        discard(spark, large_path)
        now, path = following, new_path
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))


def connected_components(vertices: DataFrame, edges: DataFrame, v: str = "v") -> DataFrame:
    """``v, root`` for all vertices; root is the smallest vertex of the component."""
    forest = star_forest(edges)
    ids = vertices.select(F.col(v).alias("v")).distinct()
    return ids.join(forest, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
