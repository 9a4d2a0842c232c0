"""Reachability kept up to date by a stream of edges, in versions that survive a restart.

The state is a folder that all executors share. ``base-N`` holds ``v, root`` of
all vertices up to batch N; ``batch-N`` holds what batches since that base changed:
``links`` (a root and the root it was joined to) and ``more`` (vertices that were new), and
last ``base``, whose marker commits the batch. So a batch costs its own edges and the
changes since the base, not all vertices, and every ``compact`` batches a new base is made.
A batch that is committed is skipped when it comes again; an attempt that was cut off
left no marker and is overwritten. Together with the stream's own checkpoint every
edge counts once, whenever the driver or an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components, star_forest
from ..operators.index import CommunityIndex
from ..storage import discard, exists, names_in


def follow_edges(index: CommunityIndex, stream: DataFrame, checkpoint: str):
    """Fold each micro-batch of ``src, dst`` into an index of this session; joining edges again changes nothing,
    so a batch that is replayed after a failure is harmless. ``Reachability`` outlives the session."""
    return stream.writeStream.foreachBatch(lambda batch, _: index.add_edges(batch)).option("checkpointLocation", checkpoint).start()


class Reachability:
    """Components of a growing graph in ``folder``; the first version is -1.

    A new session opens the folder and goes on from the last committed batch. New
    vertices may come with any edge; null ends are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, compact: int = 20):
        self.spark, self.folder, self.compact = spark, folder.rstrip("/"), compact

    def _path(self, kind: str, batch: int, part: str = "") -> str:
        return f"{self.folder}/{kind}-{batch}" + (f"/{part}" if part else "")

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def versions(self) -> list[int]:
        """The committed batches that are kept, oldest first."""
        found = [int(n.removeprefix("batch-")) for n in names_in(self.spark, self.folder) if n.startswith("batch-")]
        return sorted(n for n in found if exists(self.spark, self._path("batch", n, "base/_SUCCESS")))

    def _commit(self, batch: int, links: DataFrame, more: DataFrame, base: int) -> None:
        links.write.mode("overwrite").parquet(self._path("batch", batch, "links"))
        more.write.mode("overwrite").parquet(self._path("batch", batch, "more"))
        self.spark.range(1).select(F.lit(base).cast("long").alias("base")).write.mode("overwrite").parquet(self._path("batch", batch, "base"))

    def start(self, vertices: DataFrame, edges: DataFrame) -> None:
        """The state before any batch; nothing is done if there is one."""
        if self.versions():
            return
        connected_components(vertices, edges).write.mode("overwrite").parquet(self._path("base", -1))
        none = self.spark.createDataFrame([], "root long, to long")
        self._commit(-1, none, none.select(F.col("root").alias("v")), -1)

    def _state(self, batch: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        base = self._read(self._path("batch", batch, "base"), "base long").first().base
        links = self._read(self._path("batch", batch, "links"), "root long, to long")
        more = self._read(self._path("batch", batch, "more"), "v long")
        return self._read(self._path("base", base), "v long, root long"), links, more, base

    def components(self, batch: int | None = None) -> DataFrame:
        """``v, root`` after the last batch, or after a given one that is still kept."""
        base, links, more, _ = self._state(self.versions()[-1] if batch is None else batch)
        every = base.unionByName(more.select("v", F.col("v").alias("root")))
        return every.join(links, "root", "left").select("v", F.coalesce("to", "root").alias("root"))

    def fold(self, edges: DataFrame, batch: int) -> None:
        """Add the edges ``src, dst`` of a batch; does nothing if it or a later one is committed."""
        versions = self.versions()
        if not versions:
            raise ValueError("start the state before the first batch")
        if batch <= versions[-1]:
            return
        base, links, more, base_id = self._state(versions[-1])
        pairs = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src is not null and dst is not null")
        ends = pairs.select(F.col("src").alias("v")).union(pairs.select("dst")).distinct()
        known = base.unionByName(more.select("v", F.col("v").alias("root")))
        roots = ends.join(known, "v", "left").withColumn("new", F.col("root").isNull()).withColumn("root", F.coalesce("root", "v"))
        roots = roots.join(links, "root", "left").select("v", F.coalesce("to", "root").alias("root"), "new")
        roots.write.mode("overwrite").parquet(self._path("batch", batch, "roots"))
        roots = self._read(self._path("batch", batch, "roots"), "v long, root long, new boolean")
        a = roots.select(F.col("v").alias("src"), F.col("root").alias("a"))
        b = roots.select(F.col("v").alias("dst"), F.col("root").alias("b"))
        forest = star_forest(pairs.join(a, "src").join(b, "dst").select("a", "b"), "a", "b").withColumnRenamed("v", "from").withColumnRenamed("root", "into")
        moved = links.join(forest, F.col("to") == F.col("from"), "left").select("root", F.coalesce("into", "to").alias("to"))
        links = moved.unionByName(forest.select(F.col("from").alias("root"), F.col("into").alias("to")))
        more = more.unionByName(roots.filter("new").select("v"))
        if batch - base_id >= self.compact:
            every = base.unionByName(more.select("v", F.col("v").alias("root")))
            made = every.join(links, "root", "left").select("v", F.coalesce("to", "root").alias("root"))
            made.write.mode("overwrite").parquet(self._path("base", batch))
            links, more, base_id = links.limit(0), more.limit(0), batch
        self._commit(batch, links, more, base_id)
        self._forget(batch)

    def _forget(self, batch: int) -> None:
        """Keep this batch and the one before it, with the bases they need."""
        kept = self.versions()[-2:]
        bases = {self._state(n)[3] for n in kept}
        for name in names_in(self.spark, self.folder):
            kind, _, number = name.partition("-")
            if kind == "batch" and int(number) < kept[0] or kind == "base" and int(number) not in bases and int(number) <= batch:
                discard(self.spark, f"{self.folder}/{name}")

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Start a query that folds every micro-batch of ``src, dst``."""
        writer = stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
