import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.functions import turns
from knotwork.operators import components, detect, index, metrics, moves
from knotwork.operators.graph import Graph
from knotwork.sources import edgelist, generate


def graph(spark, pairs, count=None):
    return Graph(spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, w long"), count)


def part(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "v long, c long")


TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]


def test_triangles(spark):
    g = graph(spark, TRIANGLES)
    p = part(spark, [0, 0, 0, 1, 1, 1])
    assert metrics.modularity(g, p).first()[0] == pytest.approx(5 / 14, abs=1e-8)
    for algorithm in ("louvain", "leiden"):
        found = detect.last_level(detect.detect(g, algorithm))
        assert {r.v: r.c for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
        kernel = detect.last_level(detect.detect(g, algorithm, small_edges=100))
        assert metrics.modularity(g, kernel).first()[0] == pytest.approx(5 / 14, abs=1e-8)


def test_star_refinement_stays_connected(spark):
    near, degree = detect._links([0, 1, 2], [2, 2, 3], [1, 1, 1])
    refined = detect._refine(near, degree, {v: 0 for v in range(4)}, 0.1, 0.05)
    groups = {}
    for v, r in refined.items():
        groups.setdefault(r, set()).add(v)
    assert not any(g == {0, 1} for g in groups.values())
    g = graph(spark, [(0, 2), (1, 2), (2, 3)])
    spread = detect.refine(g.edges, part(spark, [0, 0, 0, 0]), 0.1, 0.05)
    assert moves.connectivity_splits(g, spread).first()[0] == 0


def test_multigraph_loops_and_gaps(spark):
    lines = spark.createDataFrame([("0 0",), ("0 1",), ("5 5",), ("# 1 2",), ("% 3",), ("x y",), ("7",), ("1 0 2.5",), ("-1 2",)], "value string")
    g = Graph(edgelist.parse_edge_lines(lines, weighted=True))
    assert sorted((r.src, r.dst, r.w) for r in g.edges.collect()) == [(0, 1, 1.0), (1, 0, 2.5)]
    assert g.n == 2
    gaps = graph(spark, [(0, 1), (7, 8)])
    assert gaps.n == 9 and gaps.summary().first().isolated == 5
    assert graph(spark, []).n == 0
    with pytest.raises(ValueError):
        graph(spark, [(0, 9)], 5).n


def test_repair_and_components(spark):
    g = graph(spark, [(0, 1), (2, 3)])
    p = part(spark, [0, 0, 0, 0])
    assert {r.v: r.c for r in moves.enforce_connectivity(g, p).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    assert moves.connectivity_splits(g, p).first()[0] == 1
    path = graph(spark, [(i, i + 1) for i in range(200)])
    assert components.connected_components(path.vertices, path.edges).agg(F.max("root"), F.count("*")).first() == (0, 201)
    found = index.CommunityIndex(g, p)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 99)], "u long, v long")
    assert [r.connected for r in found.connected(pairs).orderBy("v").collect()] == [True, False, None]
    found.add_edges(spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert [r.connected for r in found.connected(pairs).orderBy("v").collect()] == [True, True, None]


def test_topological_levels(spark):
    with pytest.raises(ValueError):
        index.topo_levels(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long"))


def test_coarsening_keeps_modularity(spark):
    edges, truth = generate.planted_partition(spark, 200, 10, 0.2)
    g = Graph(edges)
    coarse = Graph(moves.coarsen(g.edges, truth))
    alone = spark.range(10).select(F.col("id").alias("v"), F.col("id").alias("c"))
    assert metrics.modularity(coarse, alone).first()[0] == pytest.approx(metrics.modularity(g, truth).first()[0])


@pytest.mark.parametrize("algorithm", ["louvain", "leiden"])
def test_planted_partition_is_found(spark, algorithm):
    edges, truth = generate.planted_partition(spark)
    hierarchy = detect.detect(Graph(edges, 1000), algorithm)
    assert metrics.nmi(detect.last_level(hierarchy), truth).first()[0] > 0.95
    assert index.parents_per_child(hierarchy).filter("parents <> 1").count() == 0


def test_nmi_of_trivial_partitions(spark):
    one, two = part(spark, [0, 0, 0]), part(spark, [0, 1, 2])
    assert metrics.nmi(one, one).first()[0] == 1.0
    assert metrics.nmi(one, two).first()[0] == 0.0
    assert metrics.nmi(two, two).first()[0] == 1.0
    assert metrics.nmi(two.limit(0), two.limit(0)).first()[0] == 0.0


def test_refinement_ends_only_without_offers(spark):
    far = 1 << 17  # both ends always show the same coin
    g = graph(spark, [(0, far), (1, far + 1)])
    parents = spark.createDataFrame([(0, 0), (far, 0), (1, 1), (far + 1, 1)], "v long, c long")
    near, degree = detect._links([0, 1], [far, far + 1], [1, 1])
    kernel = detect._refine(near, degree, {0: 0, far: 0, 1: 1, far + 1: 1}, 1.0, 0.05)
    rounds = {r.v: r.c for r in detect.refine(g.edges, parents, 1.0, 0.05).collect()}
    for found in (kernel, rounds):
        assert found[0] == found[far] != found[1] == found[far + 1]


def test_both_paths_end_without_offers(spark):
    g = graph(spark, TRIANGLES)
    start = g.vertices.filter("deg > 0").select("v", F.col("v").alias("c"))
    rows = g.edges.select("src", "dst", "w").collect()
    near, degree = detect._links(*zip(*[(r.src, r.dst, r.w) for r in rows]))
    label = {v: v for v in near}
    detect._local_moves(near, degree, label, 1.0)
    kernel = spark.createDataFrame(list(label.items()), "v long, c long")
    for found in (kernel, detect.local_moving(g.edges, start, 1.0)[0]):
        assert moves.best_moves(moves.move_gains(g.adj, found, 1.0)).filter("not stay").count() == 0


def test_array_moves_end_without_offers():
    rng = np.random.default_rng(5)
    src, dst = rng.integers(0, 3000, (2, 60000))
    for w, cells in ((rng.integers(1, 4, 60000), 1 << 24), (rng.integers(1, 4, 60000), 30000), (rng.random(60000), 30000)):
        k = np.bincount(np.concatenate([src, dst]), np.concatenate([w, w]), 3000).astype(w.dtype)
        lists = turns.neighbour_lists(src, dst, w, 3000)
        was, turns.CELLS = turns.CELLS, cells
        label, changed = turns.local_moves(*lists, k, np.arange(3000), 1, k.sum(), 0 if w.dtype.kind == "i" else 1e-12)
        turns.CELLS = was
        near, degree = detect._links(src.tolist(), dst.tolist(), w.tolist())
        rest = {v: int(label[v]) for v in near}
        before = dict(rest)
        assert changed and not detect._local_moves(near, degree, rest, 1) and rest == before


def test_kernel_visits_only_vertices_with_offers(monkeypatch):
    rng = np.random.default_rng(6)
    src, dst = rng.integers(0, 400, (2, 9000))
    monkeypatch.setattr(detect, "_local_moves", lambda *_: 1 / 0)  # the walk over all vertices
    ids, levels = detect.kernel(src, dst, np.ones(9000), "leiden", 1.0, 0.05)
    assert len(ids) == 400 and len(levels) > 1 and all(len(level) == 400 for level in levels)
