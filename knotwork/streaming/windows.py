"""Graphs of sliding event-time windows.

Users are tied to what they did in a short cell of time: a window's graph is
bipartite, its edges counted by one aggregate over (window, user, cell). The same
plan runs on a table and on a stream, where the watermark bounds the counts that are
held and drops events that come later than ``late`` after the newest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_forest
from ..storage import exists

#: Bits of a vertex id within its window; the upper half of them are cells.
BITS = 40


def window_edges(
    events: DataFrame, cell: Column, size: str, slide: str | None = None, late: str = "0 seconds", ts: str = "ts", user: str = "user_id", least: int = 1
) -> DataFrame:
    """``start, end, user, cell, n``: how often users were active in cells of each window, ``least`` times or more.

    Null times, users and cells are left out.
    """
    rows = events.select(F.col(ts).alias("at"), F.col(user).alias("user"), cell.alias("cell")).filter("user is not null and cell is not null")
    counted = rows.withWatermark("at", late).groupBy(F.window("at", size, slide), "user", "cell").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least).select("window.start", "window.end", "user", "cell", "n")


def window_components(edges: DataFrame) -> DataFrame:
    """``start, user, root``: of each window the users and the smallest user whom cells connect them with.

    All windows are solved at once as one graph: ids (below 2^39) are put behind the window's number.
    """
    windows = edges.select("start").distinct()
    # one row a window
    numbered = windows.select("start", F.row_number().over(_by_start()).cast("long").alias("number"))
    base = F.shiftleft("number", BITS)
    placed = edges.join(F.broadcast(numbered), "start")
    pairs = placed.select((base + F.col("user")).alias("src"), (base + F.col("cell") + (1 << (BITS - 1))).alias("dst"), "start", "user")
    forest = star_forest(pairs)
    users = pairs.select("start", "user", F.col("src").alias("v")).distinct().join(forest, "v", "left")
    inside = F.coalesce("root", "v").bitwiseAND(F.lit((1 << BITS) - 1))
    return users.select("start", "user", inside.alias("root"))


def _by_start():
    from pyspark.sql import Window

    return Window.orderBy("start")


def follow_windows(edges: DataFrame, folder: str, checkpoint: str, **trigger):
    """Start a query that writes the components of each window to ``folder/batch=N`` once the watermark has passed it.

    A batch that comes again overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder.rstrip('/')}/batch={number}"
        if not exists(batch.sparkSession, f"{path}/_SUCCESS"):
            window_components(batch.persist()).write.mode("overwrite").parquet(path)
            batch.unpersist()

    writer = edges.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
