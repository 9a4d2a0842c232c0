"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Each source gets a target of words: its weight's share of ``share`` times all
words, never above ``cap`` times its own words; what a capped source leaves is
shared again by weight. Within a source every document expects
``target / source size`` copies. Documents are put in a fixed order, the
expected copies are prefix-summed, one random offset per source is added, and a
document is emitted once for every integer boundary its interval crosses.

The order is by size, so neighbours on the line have like sizes and the words
taken stay within a few document sizes of the target. The prefix sum is built
from cells ``(source, leading digits of size, split of id)``: counts per cell
are prefix-summed per source on a table of at most ``540 * splits`` rows a
source, and ranks inside a cell come from a window over that cell alone, so no
task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, word_count

WEIGHTS = (5, 2, 1)


def size_band(size: Column) -> Column:
    """Number of digits and the two leading digits, as one integer."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.rpad(digits, 2, "0").substr(1, 2).cast("int")


def source_key(source: Column) -> Column:
    """A key without nulls that sorts like the source by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def offset_of(source: Column, seed: int) -> Column:
    """A uniform number in [0, 1) drawn from the seed and the source's name."""
    key = F.concat(source, F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_of(doc_id: Column, splits: int) -> Column:
    mixed = F.pmod(F.coalesce(doc_id.cast("long"), F.lit(0)), F.lit(1 << 30)) * F.lit(2654435761)
    return F.floor(F.pmod(mixed, F.lit(4294967296)) / F.lit(65536)).cast("long") % F.lit(splits)


def source_targets(
    sizes: DataFrame, source: str, size: str, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """``source, source_size, target`` from the words of each row.

    Water-filling: with sources by ascending ``cap * size / weight``, the first
    ones are capped; the level of the rest is what remains over their weights.
    Windows here run over one row per source.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(source)) - 1
    per = per.withColumn("_w", F.element_at(listed, (place % len(weights)) + 1)).withColumn(
        "_ceiling", F.col("source_size") * cap
    )
    by_ratio = Window.orderBy((F.col("_ceiling") / F.col("_w")).asc(), F.col(source))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "_below": F.coalesce(F.sum("_ceiling").over(before), F.lit(0.0)),
            "_below_w": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
            "_all": F.sum("source_size").over(everything) * F.lit(float(share)),
            "_all_w": F.sum("_w").over(everything),
        }
    )
    level = (F.col("_all") - F.col("_below")) / (F.col("_all_w") - F.col("_below_w"))
    target = F.least(F.col("_ceiling"), F.greatest(level, F.lit(0.0)) * F.col("_w"))
    # once one source is below its ceiling, its level holds for all that follow
    first_free = F.first(F.when(F.col("_ceiling") > level * F.col("_w"), level), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    target = F.when(first_free.isNull(), F.col("_ceiling")).otherwise(F.least("_ceiling", first_free * F.col("_w")))
    return per.select(source, "source_size", target.cast("double").alias("target"))


def mix_sources(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights=WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    splits: int = 16,
    carry: bool = True,
) -> DataFrame:
    """``df`` with ``size, source_size, target, copies, taken`` for every row.

    ``copies`` is how often the mix takes the document (0, 1, 2 ...), ``taken``
    the words it thereby takes. Null text has size 0; null sources form one
    source, last in the order of weights; null ids count as 0 for the split.
    Equal rows take neighbouring places. An empty table gives no rows. Columns
    that clash with results are replaced; all others stay as they are, whatever
    their names. With ``carry=False`` only ``doc_id``
    and ``source`` are carried.
    """
    results = ("size", "source_size", "target", "copies", "taken")
    row = packed(df, results) if carry else F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([doc_id, source])])
    narrow = df.select(source_key(F.col(source)).alias("_source"), F.col(doc_id).alias("_id"), word_count(text).alias("_size"))
    place = {"_band": size_band(F.col("_size")), "_split": split_of(F.col("_id"), splits)}
    key = ["_source", *place]
    cells = narrow.withColumns(place).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_sum"))
    targets = source_targets(cells, "_source", "_sum", weights, share, cap)
    by_cell = Window.partitionBy("_source").orderBy("_band", "_split")
    cells = cells.withColumn("_before", F.sum("_n").over(by_cell) - F.col("_n"))
    plan = cells.join(targets, "_source").select(*key, "_before", "source_size", "target")
    rows = df.select(
        row.alias("_row"), F.col(doc_id).alias("_id"), source_key(F.col(source)).alias("_source"), word_count(text).alias("_size")
    ).withColumns(place)
    inside = Window.partitionBy(*key).orderBy("_size", "_id")
    joined = rows.withColumn("_rank", F.row_number().over(inside)).join(plan, key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("_before") + F.col("_rank")
    start = offset_of(F.col("_source"), seed)
    copies = F.least(F.floor(place * rate + start) - F.floor((place - 1) * rate + start), F.lit(int(-(-cap // 1)))).cast("long")
    return joined.withColumn("_copies", copies).select(
        "_row.*",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of ``df``, each repeated as often as it is taken."""
    rows = df.select(packed(df).alias("whole"))
    taken = mix_sources(rows, *[f"whole.{c}" for c in (text, source, doc_id)], **options).filter("copies > 0")
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
    return taken.select("whole", repeat).select("whole.*")
