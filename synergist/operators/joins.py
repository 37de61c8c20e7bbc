"""Joins by purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(df: DataFrame, scores: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join of score columns; AQE broadcasts the scores where they are small. Of
    scores that repeat a key, the largest counts."""
    one = scores.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_s")).select(*keys, *(F.col(f"_s.{c}") for c in columns))
    return df.join(one, keys, "left")


def side_vs_side(sides: DataFrame, columns: list[str]) -> DataFrame:
    """Each side aggregate beside the other side's (enemy_*), by one grouping."""
    row = F.struct("side", *columns)
    both = sides.groupBy("event_id").agg(F.min(row).alias("a"), F.max(row).alias("b")).where("a.side <> b.side")
    pair = F.explode(F.array(F.struct(F.col("a").alias("o"), F.col("b").alias("e")), F.struct(F.col("b").alias("o"), F.col("a").alias("e"))))
    return both.select("event_id", pair.alias("p")).select("event_id", "p.o.*", *(F.col(f"p.e.{c}").alias(f"enemy_{c}") for c in columns))


def missing(facts: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Facts without derived rows."""
    return facts.join(derived.select(*keys), keys, "left_anti")


def present(facts: DataFrame, needing: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of facts that have a row in ``needing``."""
    return facts.join(needing.select(*keys), keys, "left_semi").select(*keys).distinct()


def done_keys(*tables: DataFrame, key: str) -> DataFrame:
    """Union of the keys of all tables, each once."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.unionByName(t.select(key))
    return out.distinct()


def not_done(ids: DataFrame, done: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Ids neither done nor judged for good."""
    return ids.select(key).distinct().join(done.select(key).unionByName(judged.select(key)), key, "left_anti")


def common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_semi")


def unknown(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_anti")


def resolve_names(df: DataFrame, names: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their entity id, distinct names that resolve to none).

    ``names`` has (name, entity), ``aliases`` (alias, name): an alias goes first.
    """
    target = df.join(aliases.select(F.col("alias").alias("name"), F.col("name").alias("_real")), "name", "left")
    target = target.withColumn("_name", F.coalesce("_real", "name"))
    joined = target.join(names.select(F.col("name").alias("_name"), "entity"), "_name", "left").drop("_real", "_name")
    return joined.where("entity is not null"), joined.where("entity is null").select("name").distinct()


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)
