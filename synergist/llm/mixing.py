"""Mixing sources to target weights by systematic sampling.

Each document's expected copies are summed up in order within its source, one
random offset is added, and the document is emitted once for each integer that
the running sum crosses. Ordering by size first keeps a source's taken words
within one document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise

#: Weights given to the sources by code point order, repeating (fixed values).
WEIGHTS = (5, 2, 1)


def word_count(col: str = "text") -> Column:
    """Runs of characters outside the space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, stop: float = 2.0) -> DataFrame:
    """Add weight and target to (source, source_size), one row for each source.

    The targets share ``total`` times all sizes by weight; a target stops at
    ``stop`` times its source's size and the excess is reshared by weight until
    none is above. In order of stop/weight the stopped sources come first, so
    the level of the others follows from running sums. The sums run over one row for
    each source.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    w = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    s = sources.select("source", "source_size", w.cast("double").alias("weight"), F.sum("source_size").over(everything).alias("_all"))
    s = s.withColumn("_stop", F.col("source_size") * F.lit(stop))
    order = Window.orderBy(F.col("_stop") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_all") * F.lit(total) - F.coalesce(F.sum("_stop").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("_level", left / open_weight)
    # the first source that the level of the rest doesn't fill fixes the level
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_stop"), F.struct(F.col("_stop") / F.col("weight"), F.col("_level")))
    s = s.withColumn("_fixed", F.min(fits).over(everything)["_level"])
    free = F.least(F.col("_stop"), F.coalesce(F.col("_fixed") * F.col("weight"), F.col("_stop")))
    return s.select("source", "source_size", "weight", free.alias("target"))


def sample(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, stop: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document,
    and the columns ``carry``.

    Order within a source: size from large to small, then md5 of doc_id, then
    doc_id, then a hash of the text and ``carry``; rows equal in all of these are
    interchangeable and follow a number of their own. Positions are prefix sums over ranges of that
    order, so no task sees a whole source, size or id. The offset of a source comes
    from md5 of the seed and its name. Null text has size 0; null sources are one
    source, last in order; an empty source has target 0 and no copies. Repeated rows
    are separate documents.
    """
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    slim = docs.select("doc_id", "source", *carry, name.alias("_s"), word_count().alias("size"), digest.alias("_h"), F.xxhash64("text").alias("_t"), F.monotonically_increasing_id().alias("_i"))
    slim = materialise(slim, "mix")
    order = [F.col("size").desc(), F.col("_h"), F.col("doc_id"), F.col("_t"), *map(F.col, carry), F.col("_i")]
    # ranges of the order, fixed by writing them out; their number follows the cluster's
    ranged = materialise(slim.repartitionByRange("_s", *order).withColumn("_p", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("_s", "_p").agg(F.count("*").alias("_n"), F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("_size"))
    parts = materialise(parts, "parts")  # a row for each range of a source

    sizes = parts.groupBy("_s").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("_size").alias("source_size"))
    totals = targets(sizes.select("source", "source_size"), weights, total, stop)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_s")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    totals = totals.withColumn("_s", name).select("_s", "source_size", "target", rate.alias("_rate"), offset.alias("_u"))

    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("_s", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")).join(totals, "_s")
    rank = F.row_number().over(Window.partitionBy("_p", "_s").orderBy(*order))
    placed = ranged.withColumn("_rank", rank).join(bases, ["_p", "_s"])
    at = F.col("_base") + F.col("_rank")
    crossed = lambda k: F.floor(F.col("_u") + F.col("_rate") * k)
    copies = crossed(at) - crossed(at - 1)
    return placed.select("doc_id", "source", *carry, "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it.

    Rows equal in all columns take their copies together: one is repeated for all.
    """
    key, id_key, name = (free_name(docs, f"_mix_{x}") for x in ("key", "id", "copies"))
    # rows are told apart by a hash of all columns, nulls marked, besides their doc_id
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"`{c}`").isNull() for c in docs.columns))
    keyed = docs.withColumn(key, row).withColumn(id_key, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    spread = sample(keyed, carry=(key, id_key), **options).groupBy(id_key, key).agg(F.sum("copies").alias(name), F.count("*").alias("_rows"))
    spread = materialise(spread, "copies")
    again = spread.where("_rows > 1").select(id_key, key)
    if again.take(1):
        once = keyed.join(again, [id_key, key], "left_anti")
        keyed = once.unionByName(keyed.join(again, [id_key, key], "left_semi").dropDuplicates([id_key, key]))
    joined = keyed.join(spread.where(F.col(name) > 0).select(id_key, key, name), [id_key, key])
    return joined.withColumn(name, F.explode(F.array_repeat(F.lit(1), F.col(name).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
