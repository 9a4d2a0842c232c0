"""Single steps of local moving, coarsening and renumbering, each one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import place_of
from ..sources.views import tasks_for
from .components import star_forest
from .graph import Graph


def _neighbor_rows(adj: DataFrame, partition: DataFrame) -> DataFrame:
    p = partition.select(F.col("v").alias("dst"), "c")
    return adj.filter("src <> dst").join(p, "dst").select(F.col("src").alias("v"), "c", F.col("w").alias("k_in"))


def _summed(rows: DataFrame, count: int) -> DataFrame:
    """Sums of ``k_in`` by ``v, c``. Few of the rows agree, so they are dealt to as many tasks
    as they need first: summed where they are read, a task's table would grow with its split."""
    dealt = rows.repartition(tasks_for(rows.sparkSession, count), "v", "c")
    return dealt.groupBy("v", "c").agg(F.sum("k_in").alias("k_in"))


def neighbor_weights(adj: DataFrame, partition: DataFrame) -> DataFrame:
    """``v, c, k_in``: weight from a vertex to each neighbouring community, loops left out."""
    return _summed(_neighbor_rows(adj, partition), adj.count())


def move_gains(adj: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``v, c, own, gain``: 2m * k_in(c) - resolution * total'(c) * k(v), with v taken out of its community.

    Offers are the neighbouring communities and the own one. Whole weights at
    resolution 1 stay integers, so results do not depend on order.
    """
    degrees = adj.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k"))
    at = partition.join(degrees, "v")
    totals = at.groupBy("c").agg(F.sum("k").alias("total"))
    mass = degrees.agg(F.sum("k").alias("mass"))
    zero = at.select("v", "c", (F.col("k") * 0).alias("k_in"))
    offers = _summed(_neighbor_rows(adj, partition).unionByName(zero), adj.count())
    here = at.select("v", F.col("c").alias("home"), "k")
    rows = offers.join(here, "v").join(totals, "c").join(F.broadcast(mass))
    rest = F.col("total") - F.when(F.col("c") == F.col("home"), F.col("k")).otherwise(F.col("k") * 0)
    pull = rest * F.col("k")
    gain = F.col("mass") * F.col("k_in") - (pull if resolution == 1.0 else resolution * pull)
    return rows.select("v", "c", (F.col("c") == F.col("home")).alias("own"), gain.alias("gain"))


def best_moves(gains: DataFrame) -> DataFrame:
    """``v, c, gain``: the best offer; ties stay at home, else go to the smallest community."""
    best = F.max(F.struct("gain", F.col("own").alias("own"), (-F.col("c")).alias("m"))).alias("b")
    return gains.groupBy("v").agg(best).select("v", (-F.col("b.m")).alias("c"), F.col("b.own").alias("stay"), F.col("b.gain").alias("gain"))


def may_move(v, turn: int, parts: int):
    """Whether a vertex is active in a round: an arithmetic hash any engine can repeat."""
    h = F.pmod(F.pmod(v, F.lit(1 << 30)) * F.lit(2654435761) + F.lit(turn * 40503), F.lit(4294967296))
    return F.floor(h / 65536).cast("long") % parts == 0


def move_round(adj: DataFrame, partition: DataFrame, turn: int, parts: int, resolution: float = 1.0) -> DataFrame:
    """The partition after the active vertices took their best offers."""
    active = best_moves(move_gains(adj, partition, resolution)).filter(may_move(F.col("v"), turn, parts) & ~F.col("stay"))
    moved = active.select("v", F.col("c").alias("to"))
    return partition.join(moved, "v", "left").select("v", F.coalesce("to", "c").alias("c"))


def renumber(partition: DataFrame) -> DataFrame:
    """Dense labels ordered by the smallest member, ranked in blocks of ids."""
    least = partition.groupBy("c").agg(F.min("v").alias("m"))
    ids = place_of(least, "m", "id").select("c", "id")
    return partition.join(ids, "c").select("v", F.col("id").alias("c"))


def coarsen(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges between communities, once each; inner weight becomes a loop."""
    a = partition.select(F.col("v").alias("src"), F.col("c").alias("a"))
    b = partition.select(F.col("v").alias("dst"), F.col("c").alias("b"))
    joined = edges.join(a, "src").join(b, "dst")
    return joined.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w"))


def compose(partition: DataFrame, upper: DataFrame) -> DataFrame:
    """Communities of communities, for the original vertices."""
    up = upper.select(F.col("v").alias("c"), F.col("c").alias("top"))
    return partition.join(up, "c").select("v", F.col("top").alias("c"))


def inner_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    a = partition.select(F.col("v").alias("src"), F.col("c").alias("a"))
    b = partition.select(F.col("v").alias("dst"), F.col("c").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a = b").select("src", "dst", F.col("a").alias("c"), "w")


def enforce_connectivity(graph: Graph, partition: DataFrame) -> DataFrame:
    """``v, c``: every connected piece of a community is a community of its own, renumbered."""
    forest = star_forest(inner_edges(graph.edges, partition))
    pieces = partition.select("v").join(forest, "v", "left").select("v", F.coalesce("root", "v").alias("c"))
    return renumber(pieces)


def connectivity_splits(graph: Graph, partition: DataFrame) -> DataFrame:
    """How many of the given communities fall into several pieces."""
    repaired = enforce_connectivity(graph, partition).withColumnRenamed("c", "piece")
    counted = partition.join(repaired, "v").groupBy("c").agg(F.countDistinct("piece").alias("n"))
    return counted.agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("splits"))


def well_connected_vertices(graph: Graph, parents: DataFrame, factor: float = 0.05, resolution: float = 1.0) -> DataFrame:
    """``v, ok``: whether the weight to the rest of its parent community reaches
    ``factor * resolution * k(v) * (K - k(v)) / 2m``."""
    degrees = graph.adj.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k"))
    at = parents.join(degrees, "v")
    totals = at.groupBy("c").agg(F.sum("k").alias("total"))
    within = inner_edges(graph.adj.filter("src <> dst"), parents).groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("e"))
    mass = degrees.agg(F.sum("k").alias("mass"))
    rows = at.join(totals, "c").join(within, "v", "left").join(F.broadcast(mass))
    bound = F.lit(factor * resolution) * F.col("k") * (F.col("total") - F.col("k"))
    return rows.select("v", (F.coalesce("e", F.lit(0)) * F.col("mass") >= bound).alias("ok"))


def well_connected_subcommunities(
    graph: Graph, parents: DataFrame, parts: DataFrame, factor: float = 0.05, resolution: float = 1.0
) -> DataFrame:
    """``r, ok`` for sub-communities ``parts`` (v, c as r) of ``parents``, by the same bound."""
    degrees = graph.adj.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k"))
    at = parents.withColumnRenamed("c", "p").join(parts.withColumnRenamed("c", "r"), "v").join(degrees, "v")
    of_parent = at.groupBy("p").agg(F.sum("k").alias("total"))
    of_part = at.groupBy("p", "r").agg(F.sum("k").alias("k"))
    a = at.select(F.col("v").alias("src"), F.col("p").alias("pa"), F.col("r").alias("ra"))
    b = at.select(F.col("v").alias("dst"), F.col("p").alias("pb"), F.col("r").alias("rb"))
    cut = graph.adj.join(a, "src").join(b, "dst").filter("pa = pb and ra <> rb").groupBy(F.col("ra").alias("r")).agg(F.sum("w").alias("e"))
    mass = degrees.agg(F.sum("k").alias("mass"))
    rows = of_part.join(of_parent, "p").join(cut, "r", "left").join(F.broadcast(mass))
    bound = F.lit(factor * resolution) * F.col("k") * (F.col("total") - F.col("k"))
    return rows.select("r", (F.coalesce("e", F.lit(0)) * F.col("mass") >= bound).alias("ok"))
