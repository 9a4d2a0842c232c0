"""Edge-list and truth text files, id remapping, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

SPACE = r"\s+"
_ID = r"^[0-9]{1,18}$"


def parse_edge_lines(lines: DataFrame, weighted: bool = False, value: str = "value") -> DataFrame:
    """``src, dst, w`` from text lines ``u v [w]``.

    Lines starting with # or %, lines of fewer than two ids, and self-loops are
    dropped; parallel edges stay. Ids are non-negative integers. A missing or
    unreadable weight is 1; unweighted reading ignores any third column.
    """
    body = F.col(value)
    parts = F.split(F.trim(F.regexp_replace(body, r"[\s]+", " ")), " ")
    rows = lines.filter(~body.rlike("^[#%]")).select(parts.alias("p")).filter("size(p) >= 2")
    rows = rows.filter(F.col("p")[0].rlike(_ID) & F.col("p")[1].rlike(_ID))
    weight = F.coalesce(F.expr("try_cast(get(p, 2) as double)"), F.lit(1.0)) if weighted else F.lit(1.0)
    edges = rows.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"), weight.alias("w"))
    return edges.filter("src <> dst")


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    return parse_edge_lines(spark.read.text(path), weighted)


def read_truth(spark: SparkSession, path: str, vertices: DataFrame) -> DataFrame:
    """``v, c`` for all ``vertices``; unlisted ones get 0, unknown ones are ignored, repeats are refused."""
    pairs = parse_edge_lines_raw(spark.read.text(path))
    if pairs.groupBy("v").count().filter("count > 1").limit(1).count():
        raise ValueError("a vertex has two communities")
    return vertices.select("v").join(pairs, "v", "left").select("v", F.coalesce("c", F.lit(0).cast("long")).alias("c"))


def parse_edge_lines_raw(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim(F.regexp_replace("value", r"[\s]+", " ")), " ")
    rows = lines.select(parts.alias("p")).filter("size(p) >= 2")
    rows = rows.filter(F.col("p")[0].rlike(_ID) & F.col("p")[1].rlike(_ID))
    return rows.select(F.col("p")[0].cast("long").alias("v"), F.col("p")[1].cast("long").alias("c"))


def remap_ids(edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Dense ids in order of the original ones: (``src, dst, w``), (``name, id``).

    Ranks come from range partitions: a count per partition, then the place within;
    what is broadcast has one row a partition.
    """
    names = edges.select(F.col(src).alias("name")).union(edges.select(F.col(dst).alias("name"))).distinct()
    # stored, since a second run of the range partitioning could draw other bounds
    sorted_names = materialize(names.sort("name").withColumn("m", F.monotonically_increasing_id()), "names")
    part = F.shiftright("m", 33)
    sizes = sorted_names.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    ids = sorted_names.withColumn("part", part).join(F.broadcast(before), "part").select("name", (F.col("base") + inside).alias("id"))
    a = ids.select(F.col("name").alias("_a"), F.col("id").alias("_s"))
    b = ids.select(F.col("name").alias("_b"), F.col("id").alias("_d"))
    mapped = edges.join(a, edges[src] == a["_a"]).join(b, edges[dst] == b["_b"])
    return mapped.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "w"), ids


def write_edges(edges: DataFrame, path: str, weighted: bool = False) -> None:
    """Lines ``src dst`` or, with their weights, ``src dst w``."""
    columns = ["src", "dst", "w"] if weighted else ["src", "dst"]
    edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)


def size_summary(truth: DataFrame) -> DataFrame:
    """``nodes, communities, smallest, largest`` of a partition; one row."""
    sizes = truth.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"),
        F.count(F.lit(1)).alias("communities"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
    )


def write_truth(partition: DataFrame, path: str) -> None:
    rows = partition.sort("v").select(F.concat_ws(" ", F.col("v").cast("string"), F.col("c").cast("string")).alias("value"))
    rows.write.text(path)


BENCH_SCHEMA = (
    "algo string, graph string, nodes long, edges long, communities long, splits long, "
    "modularity double, nmi double, ms double"
)


def append_bench_row(spark: SparkSession, path: str, row: tuple) -> None:
    """Append one run; ``nmi`` may be None."""
    spark.createDataFrame([row], BENCH_SCHEMA).coalesce(1).write.mode("append").option("header", True).csv(path)
