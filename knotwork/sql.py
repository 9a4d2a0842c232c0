"""Results as views and table functions, for queries in SQL alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators.graph import Graph
from .operators.index import CommunityIndex

#: Functions of Spark SQL over the views; Catalyst inlines them into the query that calls them.
FUNCTIONS = {
    "neighbours_of": ("x BIGINT", "v BIGINT, w {w}", "select case when src = x then dst else src end, w from {p}edges where src = x or dst = x"),
    "members_of": ("x BIGINT", "v BIGINT", "select v from {p}partition where c = x"),
    "community_at": ("x BIGINT, l INT", "c BIGINT", "select c from {p}hierarchy where v = x and level = l"),
    "reachable_from": ("x BIGINT", "v BIGINT", "select b.v from {p}components a join {p}components b on a.root = b.root where a.v = x"),
}


def register(
    spark: SparkSession, graph: Graph, partition: DataFrame | None = None, hierarchy: DataFrame | None = None, prefix: str = ""
) -> list[str]:
    """Make the views ``edges, vertices, components`` and, if given, ``partition, hierarchy``, and their functions.

    Names begin with ``prefix``. Components are solved when registered, the rest is read when asked. Returns
    the names of all that was made.
    """
    frames = {"edges": graph.edges, "vertices": graph.vertices, "components": CommunityIndex(graph, graph.vertices).components}
    frames |= {n: df for n, df in (("partition", partition), ("hierarchy", hierarchy)) if df is not None}
    for name, df in frames.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    made = [f"{prefix}{name}" for name in frames]
    weight = dict(graph.edges.dtypes)["w"]
    needs = {"neighbours_of": "edges", "members_of": "partition", "community_at": "hierarchy", "reachable_from": "components"}
    for name, (takes, gives, body) in FUNCTIONS.items():
        if needs[name] in frames:
            returns = gives.format(w=weight)
            spark.sql(f"create or replace temporary function {prefix}{name}({takes}) returns table ({returns}) return {body.format(p=prefix)}")
            made.append(f"{prefix}{name}")
    return made
