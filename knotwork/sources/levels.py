"""A stored hierarchy: partitioned by level, bucketed by vertex."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, new_folder


class LevelStore:
    """A catalog table ``v, c, level`` in the shared folder (or ``path``).

    A question about one level reads that partition only; questions that bring their own level prune
    partitions while they run; joins by vertex find the rows dealt and sorted already.
    """

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path

    @classmethod
    def save(cls, hierarchy: DataFrame, name: str | None = None, path: str | None = None, buckets: int | None = None) -> LevelStore:
        """Store ``level, v, c``; a table of this name is replaced."""
        spark = hierarchy.sparkSession
        name, path = name or f"knotwork_levels_{uuid4().hex}", path or new_folder(spark, "levels")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"drop table if exists {name}")
        dealt = hierarchy.select("v", "c", "level").repartition(buckets, "v").sortWithinPartitions("level", "v")
        dealt.write.mode("overwrite").partitionBy("level").bucketBy(buckets, "v").sortBy("v").option("path", path).saveAsTable(name)
        return cls(spark, name, path)

    def table(self) -> DataFrame:
        """``level, v, c``."""
        return self.spark.table(self.name).select("level", "v", "c")

    def level(self, level: int) -> DataFrame:
        return self.table().filter(F.col("level") == level).select("v", "c")

    def communities(self, questions: DataFrame) -> DataFrame:
        """``v, level, c`` of questions ``v, level``; null for what is not stored."""
        return questions.select("v", "level").join(self.table(), ["level", "v"], "left").select("v", "level", "c")

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        discard(self.spark, self.path)
