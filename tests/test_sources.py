import csv
import glob

import pytest
from pyspark.sql import functions as F

from knotwork import __main__ as command
from knotwork.functions import prefix
from knotwork.operators import detect, index, metrics
from knotwork.operators.graph import Graph
from knotwork.sources import edgelist, generate
from knotwork.streaming import reach


def test_edges_survive_write_and_read(spark, tmp_path):
    rows = [(0, 1, 2.5), (1, 2, 1.0), (0, 1, 0.125)]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    edgelist.write_edges(edges, f"{tmp_path}/w", weighted=True)
    assert sorted(map(tuple, edgelist.read_edge_list(spark, f"{tmp_path}/w", True).collect())) == sorted(rows)
    edgelist.write_edges(edges, f"{tmp_path}/p")
    assert sorted(map(tuple, edgelist.read_edge_list(spark, f"{tmp_path}/p", True).collect())) == [(0, 1, 1.0), (0, 1, 1.0), (1, 2, 1.0)]


def test_truth_files(spark, tmp_path):
    edgelist.write_truth(spark.createDataFrame([(0, 3), (2, 1), (9, 9)], "v long, c long"), f"{tmp_path}/t")
    vertices = spark.range(4).withColumnRenamed("id", "v")
    assert sorted(map(tuple, edgelist.read_truth(spark, f"{tmp_path}/t", vertices).collect())) == [(0, 3), (1, 0), (2, 1), (3, 0)]
    edgelist.write_truth(spark.createDataFrame([(0, 3), (0, 1)], "v long, c long"), f"{tmp_path}/twice")
    with pytest.raises(ValueError):
        edgelist.read_truth(spark, f"{tmp_path}/twice", vertices)


def test_size_summary(spark):
    truth = spark.createDataFrame([(0, 3), (1, 3), (2, 1)], "v long, c long")
    assert tuple(edgelist.size_summary(truth).first()) == (3, 2, 1, 2)
    assert tuple(edgelist.size_summary(truth.limit(0)).first()) == (0, 0, None, None)


def test_remap_keeps_the_order_of_names(spark):
    edges = spark.createDataFrame([("b", "a", 1), ("c", "zz", 2), ("a", "d", 3)], "src string, dst string, w long")
    mapped, ids = edgelist.remap_ids(edges)
    assert [tuple(r) for r in ids.orderBy("id").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("zz", 4)]
    assert sorted(map(tuple, mapped.collect())) == [(0, 3, 3), (1, 0, 1), (2, 4, 2)]


@pytest.mark.parametrize("mu", [0.1, 0.4, 0.6])
def test_generator_meets_its_parameters(spark, mu):
    edges, truth = generate.lfr_graph(spark, mu=mu)
    a, b = (truth.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in ("src", "dst"))
    row = edges.join(a, "src").join(b, "dst").agg(F.count("*").alias("m"), F.avg((F.col("csrc") != F.col("cdst")).cast("int")).alias("out")).first()
    assert 2 * row.m / 1000 == pytest.approx(15, rel=0.02) and row.out == pytest.approx(mu, abs=0.02)
    sizes = edgelist.size_summary(truth).first()
    assert sizes.nodes == 1000 and sizes.smallest >= 20 and sizes.largest <= 220
    assert truth.agg(F.countDistinct("v"), F.min("v"), F.max("v")).first() == (1000, 0, 999)


def test_prefix_sums_across_blocks(spark):
    rows = spark.range(0, 300, 3).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"))
    got = {r.k: (r.s, r.p) for r in prefix.place_of(prefix.sum_before(rows, "k", F.col("x"), "s", 16), "k", "p", 16).collect()}
    total = 0
    for p, k in enumerate(range(0, 300, 3)):
        assert got[k] == (total, p)
        total += k % 7


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "g.edges").write_text("0 1 2\n1 2\n0 2\n3 4\n4 5\n3 5\n2 3\n")
    (tmp_path / "g.truth").write_text("".join(f"{v} {v // 3}\n" for v in range(6)))
    command.main(["stats", f"{tmp_path}/g.edges"])
    assert "isolated" in capsys.readouterr().out
    for flag in ("--louvain", "--leiden"):
        command.main(["community", f"{tmp_path}/g.edges", f"{tmp_path}/g.truth", flag, "--bench", f"{tmp_path}/bench"])
    out = capsys.readouterr().out
    assert "same_community" in out and "community_at_0" in out
    rows = [r for f in glob.glob(f"{tmp_path}/bench/*.csv") for r in csv.DictReader(open(f))]
    assert sorted(r["algo"] for r in rows) == ["leiden", "louvain"]
    assert all((r["nodes"], r["edges"], r["communities"], r["nmi"]) == ("6", "7", "2", "1.0") for r in rows)


def test_stream_of_edges(spark, tmp_path):
    graph = Graph(spark.createDataFrame([(0, 1, 1), (2, 3, 1)], "src long, dst long, w long"))
    found = index.CommunityIndex(graph, graph.vertices.select("v", F.col("v").alias("c")))
    spark.createDataFrame([(1, 2)], "src long, dst long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("src long, dst long").parquet(f"{tmp_path}/in")
    query = reach.follow_edges(found, stream, f"{tmp_path}/at")
    query.processAllAvailable()
    query.stop()
    assert found.component_sizes().collect() == [(0, 4)]


@pytest.mark.parametrize("algorithm, mu", [("louvain", 0.4), ("leiden", 0.6)])
def test_rounds_reach_the_quality_of_the_kernel(spark, algorithm, mu):
    edges, _ = generate.planted_partition(spark, 150, 5, mu)
    graph = Graph(edges, 150)
    score = []
    for small in (1 << 20, 0):
        hierarchy = detect.detect(graph, algorithm, small_edges=small)
        assert index.parents_per_child(hierarchy).filter("parents <> 1").count() == 0
        score.append(metrics.modularity(graph, detect.last_level(hierarchy)).first()[0])
    assert score[1] > score[0] * (0.99 if mu < 0.5 else 0.95)


def test_resolution_changes_the_number_of_communities(spark):
    edges, _ = generate.planted_partition(spark, 300, 10, 0.2)
    counts = [detect.last_level(detect.louvain(Graph(edges), gamma)).select("c").distinct().count() for gamma in (0.1, 1.0, 8.0)]
    assert counts[0] < counts[1] < counts[2]
