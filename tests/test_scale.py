import numpy as np
from pyspark.sql import functions as F

from knotwork.llm import neural_lm
from knotwork.operators import detect, index, moves
from knotwork.operators.graph import Graph
from knotwork.plans import queries
from knotwork.sources import views

SF = "/root/testdata/sf0.001"


def test_copurchases_take_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    few = {tuple(r) for r in views.part_copurchase(spark, SF).collect()}
    monkeypatch.setattr(views, "TASK_ROWS", 300)
    many = views.part_copurchase(spark, SF)
    assert many.rdd.getNumPartitions() >= len(few) // 300
    plan = many._jdf.queryExecution().executedPlan().toString()
    lines = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 300)
    assert "hashpartitioning(l_orderkey#" in plan and f", {lines}), REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in many.collect()} == few


def test_neighbour_weights_take_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    adj = queries.copurchases(spark, SF).adj
    parts = queries.by_size(spark, SF)
    few = [{tuple(r) for r in f(adj, parts).collect()} for f in (moves.neighbor_weights, moves.move_gains)]
    monkeypatch.setattr(views, "TASK_ROWS", 300)
    tasks = -(-adj.count() // 300)
    for f, want in zip((moves.neighbor_weights, moves.move_gains), few):
        many = f(adj, parts)
        assert {tuple(r) for r in many.collect()} == want
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(v#" in plan and f", {tasks}), REPARTITION_BY_NUM" in plan


def test_questions_take_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    found = index.CommunityIndex(queries.copurchases(spark, SF), queries.by_size(spark, SF))
    asked = queries.pairs(spark, SF)
    few = {tuple(r) for r in found.same_community(asked).collect()}
    monkeypatch.setattr(views, "TASK_ROWS", 10)
    many = found.same_community(asked)
    assert {tuple(r) for r in many.collect()} == few
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-asked.count() // 10)}), REPARTITION_BY_NUM" in plan


def test_components_are_solved_apart_as_together(spark):
    rows = []
    for copy in range(5):  # cliques in chains of different lengths, so that components have different depths
        for clique in range(3 + 4 * copy):
            first = 1000 * copy + 5 * clique
            rows += [(first + i, first + j, 1) for i in range(5) for j in range(i)] + [(first + 4, first + 5, 1)]
    graph = Graph(spark.createDataFrame(rows + [(9000, 9001, 1), (9002, 9002, 3)], "src long, dst long, w long"))
    whole = len(rows) + 2
    assert detect.component_groups(graph.edges, whole // 3) is None
    groups = detect.component_groups(graph.edges, whole // 2)
    assert groups.select("g").distinct().count() > 1 and groups.count() == groups.select("v").distinct().count()
    for algorithm in ("louvain", "leiden"):
        together = {tuple(r) for r in detect.last_level(detect.detect(graph, algorithm)).collect()}
        apart = detect.detect(graph, algorithm, small_edges=whole // 2)
        assert {tuple(r) for r in detect.last_level(apart).collect()} == together
        assert index.parents_per_child(apart).filter("parents <> 1").isEmpty()
        assert apart.groupBy("level").count().select("count").distinct().count() == 1


def test_every_training_token_reaches_the_network(spark, monkeypatch):
    table = spark.createDataFrame([(i, f"the {i} cat sat on mat {i % 7}") for i in range(400)], "doc_id long, text string")
    seen = []
    fit = neural_lm.fit_shards

    def counted(examples, net, shards, noise, epochs, *rest):
        sizes = {r.shard: r.n for r in examples.groupBy("shard").agg((F.sum(F.length("drawn")) / 6).alias("n")).collect()}
        seen.append((sum(sizes.values()), len(sizes), shards))
        fit(examples, net, shards, noise, epochs, *rest)

    monkeypatch.setattr(neural_lm, "fit_shards", counted)
    scores = []
    for rows in (table, table.repartition(5)):
        scored, model = neural_lm.score_documents(rows, rows, examples=100, shard=300)
        scores.append({r.doc_id: r.score for r in scored.collect()})
    # every token and end mark once, dealt over all shards; the fit does not depend on the tasks
    assert seen == [(3200, 10, 10)] * 2 and model.totals["seen"] == model.totals["tokens"] == 3200
    assert scores[0] == scores[1]


def test_blocks_leave_no_offer(spark, monkeypatch):
    """Components over the kernel's bound converge by blocks, with the in-turn tail off."""
    rows = spark.sql("select pmod(xxhash64(id), 30) as src, pmod(xxhash64(id, 1), 30) as dst, 1L + id % 3 as w from range(150)").filter("src <> dst")
    graph = Graph(rows)
    used = []
    real = detect._in_blocks
    monkeypatch.setattr(detect, "_in_blocks", lambda *a: used.append(a[1] is None) or real(*a))
    found = detect.detect(graph, small_edges=60, tail=0, block=30)
    assert True in used
    assert not any(queries.louvain_faults(graph, found).first()) and index.parents_per_child(found).filter("parents <> 1").isEmpty()


def test_parents_are_refined_apart_as_together(spark):
    rows = spark.sql("select pmod(xxhash64(id), 60) as src, pmod(xxhash64(id, 1), 60) as dst, 1L as w from range(400)").filter("src <> dst")
    parents = spark.range(60).select(F.col("id").alias("v"), (F.col("id") % 4).alias("c"))
    near, degree = detect._links(*zip(*[(r.src, r.dst, r.w) for r in rows.collect()]))
    ids = {v: v % 4 for v in near}
    want = detect._refine(near, degree, ids, 1, 0.05)
    for block in (5, 1 << 18):
        got = detect.refine_apart(rows, parents, 1.0, 0.05, 1000, block)
        assert {r.v: r.c for r in got.collect()} == want
    large = {r.v: r.c for r in detect.refine_apart(rows, parents, 1.0, 0.05, 1).collect()}  # by rounds
    assert large.keys() == want.keys() and all(large[v] % 4 == v % 4 for v in large)


def test_parallel_edges_count_once_for_the_kernel(spark, monkeypatch):
    rows = [(a, b, 1) for a in range(8) for b in range(8) if a != b] * 3
    monkeypatch.setattr(detect, "local_moving", lambda *_: 1 / 0)
    found = detect.detect(Graph(spark.createDataFrame(rows, "src long, dst long, w long")), small_edges=28)
    assert detect.last_level(found).select("c").distinct().count() == 1


def test_network_is_fitted_in_single_precision():
    net = neural_lm.LogBilinear(np.array([5.0, 3, 2, 1]), 4, 1)
    net.fit(np.array([[3, 3, 1], [3, 1, 2], [1, 2, 3]] * 50), 8, 20, 0.1)
    assert net.state().dtype == np.float32
    far, near, target, bias, norm = (x.astype(float) for x in net.vectors())
    totals = np.log10((10 ** ((far[3] + near[1]) @ target.T + bias)).sum())
    assert abs(totals - norm[3, 1]) < 1e-5
