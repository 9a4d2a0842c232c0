"""Bucketed neighbour lists, stored levels, topological levels, views, run metrics."""

import random

import pytest
from pyspark.sql import functions as F

from knotwork import runs, sql
from knotwork.operators import detect, index, layout, metrics, moves, topo
from knotwork.operators.graph import Graph
from knotwork.plans import queries
from knotwork.sources import generate
from knotwork.sources.levels import LevelStore

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_do_not_move_the_lists(spark, no_broadcast):
    edges = spark.range(5000).select(F.col("id").alias("src"), (F.col("id") * 7 % 5003).alias("dst"), F.lit(1).cast("long").alias("w"))
    near = layout.store_neighbours(edges)
    met = near.meet(spark.range(5003).select(F.col("id").alias("v"), (F.col("id") % 10).alias("c")))
    exchanges = [line for line in plan_of(met).splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "SortMergeJoin" in plan_of(met), plan_of(met)  # of the labels
    assert met.count() == 2 * edges.filter("src <> dst").count()
    near.drop()


def test_hubs_are_split(spark):
    """A star: no slot holds over twice the median, and rounds give what they give without slots."""
    star = spark.range(1, 4001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1).cast("long").alias("w"))
    near = layout.store_neighbours(star, hub=100)
    sizes = sorted(r.n for r in near.rows.filter("dst = 0").groupBy("slot").agg(F.count("*").alias("n")).collect())
    assert len(sizes) == 40 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    labels = spark.range(4001).select(F.col("id").alias("v"), (F.col("id") % 3).alias("c"))
    got = near.meet(labels).groupBy("src", "c").agg(F.sum("w").alias("k")).collect()
    want = layout.store_neighbours(star).meet(labels).groupBy("src", "c").agg(F.sum("w").alias("k")).collect()
    assert sorted(got) == sorted(want) and len(got) == 4003
    near.drop()


@pytest.mark.parametrize("kind, gamma", [("long", 1.0), ("decimal(38,0)", 1.0), ("double", 1.0), ("double", 0.7)])
def test_settled_moves_raise_modularity(spark, kind, gamma):
    """From random partitions, and by at least the gains less the price."""
    draw = random.Random(gamma)
    for k in (20,):
        rows = {tuple(sorted(draw.sample(range(120), 2))): draw.randint(1, 3) for _ in range(900)}
        graph = Graph(spark.createDataFrame([(*e, w) for e, w in rows.items()], "src long, dst long, w long"))
        degrees = graph.vertices.filter("deg > 0")
        now = degrees.select("v", (F.xxhash64("v", F.lit(k)) % k).alias("c"), F.col("k").cast(kind).alias("k"))
        found, mass = detect.number_of(graph.edges, gamma)
        assert (found, mass) == ("long" if gamma == 1 else "double", 2 * sum(rows.values()))
        near = layout.store_neighbours(graph.edges)
        offers = detect._offers(near, None, now, kind, mass, gamma)
        chosen = detect.settle(offers, kind, gamma, 1)
        after = now.join(chosen, "v", "left").select("v", F.coalesce("to", "c").alias("c"))
        scores = [metrics.community_sums(graph, p, gamma).agg(F.sum("part")).first()[0] for p in (now.select("v", "c"), after)]
        assert chosen.count() > 0 and scores[1] > scores[0]
        near.drop()


def test_offers_are_those_of_the_single_steps(spark):
    graph = queries.copurchases(spark, SF)
    start = queries.by_size(spark, SF).join(graph.vertices.filter("deg > 0").select("v"), "v", "left_semi")
    want = {r.v: r.c for r in moves.best_moves(moves.move_gains(graph.adj, start)).filter("not stay").collect()}
    now = start.join(graph.vertices.select("v", "k"), "v")
    kind, mass = detect.number_of(graph.edges, 1.0)
    got = detect._offers(layout.store_neighbours(graph.edges), None, now, kind, mass, 1.0).collect()
    assert {r.v: r.to for r in got} == want and want


def test_small_gains_of_heavy_graphs_count(spark):
    """A pair of light vertices beside a weight of 10^12 still meets."""
    edges = spark.createDataFrame([(0, 1, 10**12), (2, 3, 1), (3, 4, 1), (2, 4, 1)], "src long, dst long, w long")
    found = {r.v: r.c for r in detect.last_level(detect.louvain(Graph(edges))).collect()}
    assert found == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}


@pytest.mark.parametrize("name", ["open", "merged", "split", "parents", "poor"])
def test_bad_hierarchies_turn_the_checks_red(spark, name, monkeypatch):
    """Each fault that the invariants name is seen."""
    monkeypatch.setattr(queries, "BOUND_ROUNDS", 2)
    edges, truth = generate.planted_partition(spark, 60, 3, 0.05)
    graph = Graph(edges.withColumn("w", F.col("w").cast("long")), 60)
    good = truth.select(F.lit(0).alias("level"), "v", "c")
    part = {
        "open": F.when(F.col("v") == 0, 1).otherwise(F.col("c")),
        "merged": F.col("v"),
        "split": F.pmod(F.col("v"), F.lit(30)),
        "parents": F.col("c"),
        "poor": F.floor(F.col("v") / 20),
    }[name]
    bad = good.withColumn("c", part.cast("long"))
    if name == "parents":
        bad = good.unionByName(good.withColumns({"level": F.lit(1), "c": F.floor(F.col("v") / 20).cast("long")}))
    checks = queries.louvain_faults if name in ("open", "merged") else queries.leiden_faults
    fine, row = (queries.sound(graph, h, checks(graph, h)).first() for h in (good, bad))
    assert fine.reached and fine.single_parent and fine.dense and fine.covered
    assert not sum(fine[c] for c in ("open", "mergeable", "splits") if c in fine)
    seen = {"open": lambda: row.open > 0, "merged": lambda: row.mergeable > 0, "split": lambda: row.splits > 0, "parents": lambda: not row.single_parent}
    assert seen.get(name, lambda: not row.reached)()


def plain_levels(arcs):
    into, nodes = {}, set()
    for a, b in arcs:
        into.setdefault(b, set()).add(a)
        nodes |= {a, b}
    level = {}
    while len(level) < len(nodes):
        free = [n for n in nodes - level.keys() if into.get(n, set()) <= level.keys()]
        if not free:
            return None
        level |= {n: max((level[a] + 1 for a in into.get(n, ())), default=0) for n in free}
    return level


def test_topological_levels_of_random_graphs(spark):
    draw = random.Random(2)
    for n, m, back in ((40, 45, 0), (15, 20, 1)):
        arcs = [tuple(sorted(draw.sample(range(n), 2))) for _ in range(m)]
        arcs += [(b, a) for a, b in arcs[:back]] + arcs[:3]
        want = plain_levels(arcs)
        df = spark.createDataFrame([*arcs, (None, 1), (1, None)], "src long, dst long")
        if want is None:
            with pytest.raises(ValueError):
                topo.topo_levels(df)
        else:
            assert {r.node: r.level for r in topo.topo_levels(df).collect()} == want
    with pytest.raises(ValueError):
        topo.topo_levels(spark.createDataFrame([(0, 1), (5, 5)], "src long, dst long"))
    assert topo.topo_levels(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_long_chain_takes_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    levels, rounds = topo._levels(chain)
    assert rounds < 40
    assert levels.agg(F.count("*"), F.max("level"), F.sum((F.col("level") != F.col("node")).cast("int"))).first() == (n + 1, n, 0)


def test_level_store_reads_one_partition(spark):
    hierarchy = queries.fixed_hierarchy(spark, SF)
    store = LevelStore.save(hierarchy)
    plan = plan_of(store.level(1))
    assert "PartitionFilters: [isnotnull(level" in plan and "level#" in plan and store.level(1).inputFiles()
    assert sorted(store.table().collect()) == sorted(hierarchy.collect())
    asked = spark.createDataFrame([(3, 0), (100, 2), (5, 9)], "v long, level int")
    assert sorted((r.v, r.level, r.c) for r in store.communities(asked).collect() if r.c is not None) == [(3, 0, 0), (100, 2, 0)]
    store.drop()


def test_queries_in_sql_alone(spark):
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (4, 5, 1)], "src long, dst long, w long")
    graph = Graph(edges)
    partition = spark.createDataFrame([(v, v // 3) for v in range(6)], "v long, c long")
    made = sql.register(spark, graph, partition, partition.select(F.lit(0).alias("level"), "v", "c"), prefix="g_")
    assert {"g_edges", "g_vertices", "g_components", "g_partition", "g_hierarchy", "g_members_of"} <= set(made)
    inside = "select p.c, sum(w) as w from g_edges join g_partition p on p.v = src join g_partition q on q.v = dst where p.c = q.c group by p.c order by 1"
    assert [tuple(r) for r in spark.sql(inside).collect()] == [(0, 3), (1, 1)]
    assert sorted(r.v for r in spark.sql("select v from g_reachable_from(1)").collect()) == [0, 1, 2]
    assert sorted(r.v for r in spark.sql("select v from g_members_of(1)").collect()) == [3, 4, 5]
    assert sorted(tuple(r) for r in spark.sql("select * from g_neighbours_of(1)").collect()) == [(0, 2), (2, 1)]
    assert spark.sql("select c from g_community_at(4, 0)").first().c == 1


def test_neighbours_and_communities_of_vertices(spark):
    graph = Graph(spark.createDataFrame([(0, 1, 2), (1, 2, 1)], "src long, dst long, w long"))
    assert sorted(tuple(r) for r in graph.neighbors(1).collect()) == [(0, 2), (2, 1)] and graph.neighbors(9).count() == 0
    partition = spark.createDataFrame([(0, 7), (1, 7), (2, 8)], "v long, c long")
    asked = index.CommunityIndex(graph, partition).community_of(spark.createDataFrame([(2,), (5,)], "v long"))
    assert sorted((r.v, r.c) for r in asked.collect()) == [(2, 8), (5, None)]


def test_run_metrics(spark):
    with runs.Run(spark) as run:
        spark.range(10).count()
    assert run.ms > 0
    if run.peak is not None:  # the first heartbeat comes after ten seconds
        assert run.peak > 1 << 20 and run.per_edge(1000) == run.peak / 1000
    assert runs.Run(spark).per_edge(0) is None
