"""Graphs over the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    rows = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .filter("a <> b")
    )
    return rows.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count(F.lit(1)).alias("w"))


NATION_TRADE_SQL = """(select least(c_nationkey, s_nationkey)::bigint as src, greatest(c_nationkey, s_nationkey)::bigint as dst, count(*) as w
  from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey
  join supplier on s_suppkey = l_suppkey where c_nationkey <> s_nationkey group by all)"""


#: Rows that a task joins or sums, about.
TASK_ROWS = 1 << 20


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: they grow with the rows, so that a task's memory does not."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def part_copurchase(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """Pairs of parts of one order, counted. The lines are dealt by order and the pairs by both parts, each to as many tasks as they need."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    dealt = lines.repartition(tasks_for(spark, lines.count()), "l_orderkey")
    size = F.count(F.lit(1))
    most = dealt.groupBy("l_orderkey").agg((size * (size - 1) / 2).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    items = dealt.distinct()
    other = items.select("l_orderkey", F.col("l_partkey").alias("dst"))
    pairs = items.withColumnRenamed("l_partkey", "src").join(other, "l_orderkey").filter("src < dst").select("src", "dst")
    pairs = pairs.repartition(tasks_for(spark, most), "src", "dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).filter(F.col("w") >= least)


COPURCHASE_SQL = """(select a.l_partkey as src, b.l_partkey as dst, count(*) as w
  from (select distinct l_orderkey, l_partkey from lineitem) a
  join (select distinct l_orderkey, l_partkey from lineitem) b
    on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by all)"""


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite; supplier ids follow the customers'."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    offset = table(spark, sf_dir, "customer").agg((F.max("c_custkey") + 1).alias("o"))
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return pairs.join(F.broadcast(offset)).select(
        F.col("o_custkey").alias("src"), (F.col("l_suppkey") + F.col("o")).alias("dst"), F.lit(1).cast("long").alias("w")
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to the targets of their links; string ids."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    links = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), hrefs.alias("dst"))
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


PAGE_LINKS_SQL = """(select 'p' || page_id as src, dst, count(*) as w
  from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as dst from pages) group by all)"""


def event_succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User of an event to the user of the next, counted.

    The next event is found per day, and days are joined at their ends, so no
    task sorts all events.
    """
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    order = Window.partitionBy("day").orderBy("ts", "event_id")
    inside = events.withColumn("dst", F.lead("user_id").over(order)).filter("dst is not null").select(F.col("user_id").alias("src"), "dst")
    ends = events.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("a"), F.max_by("user_id", F.struct("ts", "event_id")).alias("z"))
    across = ends.withColumn("dst", F.lead("a").over(Window.orderBy("day"))).filter("dst is not null").select(F.col("z").alias("src"), "dst")
    return inside.union(across).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


SUCCESSION_SQL = """(select src, dst, count(*) as w from (select user_id as src, lead(user_id) over (order by ts, event_id) as dst from events)
  where dst is not null and src <> dst group by all)"""
