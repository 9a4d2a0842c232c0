"""Benchmark graphs with planted communities, generated in parallel from a seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefix import hashed, sum_before, unit

#: Stubs that a bucket of those sent out of their communities holds, about.
MIXED = 1 << 16


def planted_partition(
    spark: SparkSession, n: int = 1000, k: int = 20, mu: float = 0.1, degree: float = 15, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Edges and truth (``c = v % k``): each vertex draws degree/2 partners, inside with probability 1 - mu."""
    draws = int(degree / 2 + 0.5)
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("i"))
    out = unit(F.col("src"), F.col("i"), seed=seed) < mu
    pick = unit(F.col("src"), F.col("i"), seed=seed + 1)
    anyone = F.floor(pick * n)
    inside = F.floor(pick * (n // k)) * k + F.pmod("src", F.lit(k))
    edges = rows.select("src", F.when(out, anyone).otherwise(inside).cast("long").alias("dst"), F.lit(1.0).alias("w"))
    truth = spark.range(n).select(F.col("id").alias("v"), F.pmod("id", F.lit(k)).alias("c"))
    return edges.filter((F.col("src") != F.col("dst")) & (F.col("dst") < n)), truth


def lfr_graph(
    spark: SparkSession,
    n: int = 1000,
    mu: float = 0.1,
    tau1: float = 2.5,
    tau2: float = 1.5,
    avg_degree: float = 15,
    min_community: int = 20,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Power-law degrees and community sizes; stubs are paired within communities and globally.

    Sizes come from the inverse distribution by a hash of the rank; degrees are its
    quantiles, dealt to vertices by a multiplication modulo ``n``; the least degree
    is solved so that the mean of the capped degrees is ``avg_degree``. A vertex
    sends so many stubs out that the share ``mu`` leaves its community. Stubs are put in hashed order per community (or, for those sent out, per
    bucket of about ``MIXED`` stubs) and neighbours are joined; pairs of one
    vertex with itself then swap ends among themselves. All steps are tables.
    """
    most = max(min_community + 1, n // 5)
    a, b = min_community ** (1 - tau2), most ** (1 - tau2)
    ranks = spark.range(max(1, n // min_community)).withColumnRenamed("id", "i")
    size = F.floor(F.pow(F.lit(a) + unit(F.col("i"), seed=seed) * F.lit(b - a), F.lit(1 / (1 - tau2)))).cast("long")
    drawn = sum_before(ranks.withColumn("size", size), "i", F.col("size"), "start").filter(F.col("start") < n)
    left = F.lit(n) - F.col("start")  # what remains after the last whole community joins it
    drawn = drawn.withColumn("size", F.least("size", left)).withColumn("last", F.col("start") + F.col("size") >= n)
    short = drawn.filter(F.col("last") & (F.col("size") < min_community) & (F.col("i") > 0)).select((F.col("i") - 1).alias("i"), F.col("size").alias("more"))
    whole = drawn.join(short.select((F.col("i") + 1).alias("i")), "i", "left_anti").join(short, "i", "left")
    whole = whole.withColumn("size", F.col("size") + F.coalesce("more", F.lit(0)))
    members = F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("v")
    truth = whole.select(members, F.col("i").alias("c"), (mu / (1 - F.col("size") / n)).alias("away"))
    turn = next(x for x in range(int(n * 0.618) + 1, 2 * n + 2) if math.gcd(x, n) == 1)
    low, cap = least_degree(avg_degree, tau1, max(1, n // 10)), max(1, n // 10)
    exact = F.least(F.lit(float(cap)), F.lit(low) * F.pow((F.pmod(F.col("v") * turn + seed, F.lit(n)) + 0.5) / n, F.lit(-1 / (tau1 - 1))))
    degree = F.floor(exact + unit(F.col("v"), seed=seed + 4)).cast("int")  # rounded at random, so the mean stays
    buckets = max(1, int(n * avg_degree * mu) // MIXED)
    stubs = truth.withColumn("k", degree).filter("k > 0").select("v", "c", "away", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i"))
    out = unit(F.col("v"), F.col("i"), seed=seed + 2) < F.col("away")
    stubs = stubs.select("v", F.when(out, -1 - hashed(F.col("v"), F.col("i"), seed=seed + 5) % buckets).otherwise(F.col("c")).alias("g"), "i")
    order = Window.partitionBy("g").orderBy(hashed(F.col("v"), F.col("i"), seed=seed + 3), "v", "i")
    placed = stubs.withColumn("place", F.row_number().over(order)).withColumn("dst", F.lead("v").over(order))
    pairs = placed.filter("place % 2 = 1 and dst is not null").select("g", "place", F.col("v").alias("src"), "dst")
    alone = pairs.filter("src = dst")
    near = Window.partitionBy("g").orderBy("place")
    first = F.first("dst").over(near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    swapped = alone.select("src", F.coalesce(F.lead("dst").over(near), first).alias("dst"))
    edges = pairs.filter("src <> dst").select("src", "dst").unionByName(swapped.filter("src <> dst"))
    return edges.select("src", "dst", F.lit(1.0).alias("w")), truth.select("v", "c")


def least_degree(mean: float, tau: float, cap: float) -> float:
    """The least value of a power law of exponent ``tau`` whose values, capped, have the given mean."""
    a = tau - 1
    low, high = 0.0, min(mean, cap)
    for _ in range(100):
        middle = (low + high) / 2
        got = middle * (a - (middle / cap) ** (a - 1)) / (a - 1)
        low, high = (middle, high) if got < mean else (low, middle)
    return high
