"""Durable reachability and windowed graphs, as streams that stop and start again."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from knotwork.operators import components
from knotwork.streaming import reach, windows

SCHEMA = "src long, dst long"


def roots(df):
    return {r.v: r.root for r in df.collect()}


def test_batches_against_one_run(spark, tmp_path):
    edges = [(i * 17 % 50, i * 29 % 61) for i in range(40)] + [(None, 3), (70, 70)]
    start = spark.createDataFrame([(0, 1), (2, 3)], SCHEMA)
    state = reach.Reachability(spark, f"{tmp_path}/state", compact=3)
    state.start(spark.range(40).withColumnRenamed("id", "v"), start)
    for batch in range(8):
        part = spark.createDataFrame(edges[batch * 5 : batch * 5 + 7], SCHEMA)
        state.fold(part, batch)
        before = roots(state.components())
        state.fold(spark.createDataFrame([(0, 39)], SCHEMA), batch)  # a batch that comes again is skipped
        assert roots(state.components()) == before
    every = spark.createDataFrame(edges, SCHEMA).filter("src is not null").unionByName(start)
    vertices = spark.range(40).withColumnRenamed("id", "v").union(every.select("src")).union(every.select("dst"))
    assert roots(state.components()) == roots(components.connected_components(vertices, every))
    assert len(state.versions()) == 2 and roots(reach.Reachability(spark, f"{tmp_path}/state").components()) == before


def test_cut_off_batch_is_done_again(spark, tmp_path, monkeypatch):
    state = reach.Reachability(spark, f"{tmp_path}/state")
    with pytest.raises(ValueError):
        state.fold(spark.createDataFrame([(0, 1)], SCHEMA), 0)
    state.start(spark.range(4).withColumnRenamed("id", "v"), spark.createDataFrame([], SCHEMA))

    def cut(self, batch, links, more, base):
        links.write.parquet(self._path("batch", batch, "links"))
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(reach.Reachability, "_commit", cut)
        with pytest.raises(RuntimeError):
            state.fold(spark.createDataFrame([(0, 1)], SCHEMA), 0)
    again = reach.Reachability(spark, f"{tmp_path}/state")
    assert again.versions() == [-1] and roots(again.components())[1] == 1
    again.fold(spark.createDataFrame([(0, 1)], SCHEMA), 0)
    assert roots(again.components()) == {0: 0, 1: 0, 2: 2, 3: 3}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Files come one a batch; the query stops between batches and a new one goes on."""
    for i, pair in enumerate([(0, 1), (2, 3), (1, 2)]):
        spark.createDataFrame([pair], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state = reach.Reachability(spark, f"{tmp_path}/state")  # a new object each time: nothing is kept in memory
        state.start(spark.range(5).withColumnRenamed("id", "v"), spark.createDataFrame([], SCHEMA))
        query = state.follow(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/at", availableNow=True)
        query.awaitTermination()
    assert state.versions() == [1, 2] and roots(state.components()) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}


BEGIN = datetime(2024, 1, 1)


def event(minute, user, cell):
    return (BEGIN + timedelta(minutes=minute), user, cell)


def test_window_components(spark):
    rows = [event(1, 5, 1), event(2, 3, 1), event(3, 8, 2), event(14, 8, 2), event(15, 3, 2), event(16, 9, None)]
    events = spark.createDataFrame(rows, "ts timestamp, user_id long, cell long")
    edges = windows.window_edges(events, F.col("cell"), "10 minutes")
    found = sorted((r.start.minute, r.user, r.root) for r in windows.window_components(edges).collect())
    assert found == [(0, 3, 3), (0, 5, 3), (0, 8, 8), (10, 3, 3), (10, 8, 3)]
    slid = windows.window_components(windows.window_edges(events, F.col("cell"), "20 minutes", "10 minutes"))
    # the window from 0:00 joins all by cell 2, since user 3 is in both cells
    assert {r.root for r in slid.collect() if r.start == BEGIN} == {3}
    assert windows.window_components(edges.limit(0)).count() == 0


def test_windows_of_a_stream_drop_late_events(spark, tmp_path):
    schema = "ts timestamp, user_id long, cell long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for rows in ([event(1, 5, 1), event(2, 3, 1)], [event(30, 1, 1)], [event(3, 2, 1), event(31, 4, 1)], [event(70, 1, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        edges = windows.window_edges(stream, F.col("cell"), "10 minutes", late="5 minutes")
        windows.follow_windows(edges, f"{tmp_path}/out", f"{tmp_path}/at", availableNow=True).awaitTermination()
    found = sorted((r.start.minute, r.user, r.root) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [(0, 3, 3), (0, 5, 3), (30, 1, 1), (30, 4, 1)]  # user 2 came too late, the window from 1:10 is open
