"""Prefix sums and ranks over integer keys in two levels: blocks of keys, then rows of a block, so no task holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def sum_before(df: DataFrame, key: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of smaller ``key``; keys are distinct integers that are not negative.

    The window without partitions runs over one row a block.
    """
    rows = df.withColumns({"_value": value, "_block": F.floor(F.col(key) / block)})
    totals = rows.groupBy("_block").agg(F.sum("_value").alias("_total"))
    before = totals.select("_block", (F.sum("_total").over(Window.orderBy("_block")) - F.col("_total")).alias("_base"))
    inside = F.sum("_value").over(Window.partitionBy("_block").orderBy(key)) - F.col("_value")
    placed = rows.withColumn("_inside", inside).join(before, "_block")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + F.col("_inside")).alias(name))


def place_of(df: DataFrame, key: str, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the rank of each distinct integer ``key``, from 0."""
    return sum_before(df, key, F.lit(1).cast("long"), name, block)


def hashed(*parts: Column, seed: int = 0) -> Column:
    """A hash of 32 bits."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 32))


def unit(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) drawn from integers."""
    return hashed(*parts, seed=seed).cast("double") / F.lit(float(1 << 32))
