"""Exact duplicate removal by skew-safe combining (DataFrame operations only).

Equal texts are merged in three steps, each of which groups on the full text:

1. *locally*: the partial aggregate in each map task leaves one row per text;
2. *salted*: local winners meet per ``(digest, text, salt)``. Texts whose digest
   occurs more than ``hot_rows`` times are spread over ``salts`` reducers, all
   others use the single salt 0 and are final after this step;
3. *globally*: the salt winners of hot texts - at most ``salts`` rows each - meet.

The hot list is bounded by ``rows / hot_rows`` keys and is broadcast only below
``broadcast_keys``; beyond that it is joined. Only narrow rows (id and digests)
are shuffled to carry the decision back, and adaptive skew joins split the hot
digests there, because each side is dealt by its key alone. There a text is
known by its SHA-256, xxhash64 and length together: the merging compares full
content, the way back takes the equality of all three for that of content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

NORMALIZERS = {
    "none": lambda c: c,
    "lower": lambda c: F.lower(c),
    "space": lambda c: F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " ")),
    "lower_space": lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\x20\x09-\x0D]+", " ")),
}


def _normal(text: str, how: str) -> Column:
    return NORMALIZERS[how](F.coalesce(F.col(text), F.lit("")))


def text_classes(
    df: DataFrame,
    text: str = "text",
    order: str = "doc_id",
    normalize: str = "none",
    salts: int = 32,
    hot_rows: int = 20_000,
    broadcast_keys: int = 200_000,
) -> DataFrame:
    """One row per distinct text: ``_k1, _k2, _k3`` (digests), ``keep_id``, ``group_size``."""
    body = df.select(F.col(order).alias("_id"), _normal(text, normalize).alias("_text"))
    body = body.select("_id", "_text", F.xxhash64("_text").alias("_k2"))
    hot = body.groupBy("_k2").count().filter(F.col("count") > hot_rows).select("_k2", F.lit(True).alias("_hot"))
    if hot.limit(broadcast_keys + 1).count() <= broadcast_keys:
        hot = F.broadcast(hot)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(salts))).otherwise(0)
    salted = (
        body.join(hot, "_k2", "left")
        .groupBy("_k2", "_text", F.coalesce("_hot", F.lit(False)).alias("_hot"), salt.alias("_salt"))
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    merged = (
        salted.filter("_hot")
        .groupBy("_k2", "_text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    classes = salted.filter(~F.col("_hot")).select(merged.columns).unionByName(merged)
    return classes.select(
        F.sha2("_text", 256).alias("_k1"), "_k2", F.length("_text").alias("_k3"), "keep_id", "group_size"
    )


def exact_duplicates(
    df: DataFrame, text: str = "text", order: str = "doc_id", normalize: str = "none", **options
) -> DataFrame:
    """``df`` with ``keep_id, group_size, kept, text_sha256`` for every row.

    The row with the largest ``order`` value of each group of equal texts stays.
    Null text equals empty text. Rows that repeat an id are all kept or all
    dropped with it. Null ids sort below all others; a group of only null ids
    has a null ``keep_id`` and keeps its rows. An empty table gives no rows.
    Columns of ``df`` that clash with the four results are replaced.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    classes = text_classes(df, text, order, normalize, **options)
    norm = _normal(text, normalize)
    keyed = df.select(
        packed(df, results).alias("_row"),
        F.col(order).alias("_id"),
        F.sha2(norm, 256).alias("_k1"),
        F.xxhash64(norm).alias("_k2"),
        F.length(norm).alias("_k3"),
    )
    return keyed.join(classes, ["_k1", "_k2", "_k3"]).select(
        "_row.*", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("_id")).alias("kept"), F.col("_k1").alias("text_sha256")
    )
