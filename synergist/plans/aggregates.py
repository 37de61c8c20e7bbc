"""Rebuild of all aggregate tables of one or more periods."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..sources.scratch import checkpointed
from ..sources.sinks import refresh_partitions

DUO_KEYS = ["roles", "a", "b"]
TRIO_KEYS = list(A.TRIO)
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def side_rows(sides: DataFrame, roles: DataFrame, events: DataFrame) -> DataFrame:
    """Side facts with their event, wide role maps and team gold: one shuffle by
    event feeds every combination aggregate."""
    wide = A.wide_sides(roles)
    wide = wide.withColumn("team_gold_diff_15", A.team_gold_column())
    return A.with_event(sides.drop("period", "segment", "duration_s"), events).join(wide, ["event_id", "side"], "left")


def build_aggregates(events: DataFrame, picks: DataFrame, sides: DataFrame, roles: DataFrame, periods: list[str] | None = None) -> dict[str, DataFrame]:
    """individual, matchup, duo, trio, duo_duration and trio_duration.

    ``periods`` prunes every input first (a partition filter on stored facts).
    """
    if periods is not None:
        events = events.where(F.col("period").isin(*periods))
    placed = A.with_event(picks.drop("period", "segment", "duration_s"), events)
    rows = side_rows(sides, roles.drop("period", "segment", "duration_s"), events)
    return {"individual": A.individual(placed), "matchup": A.matchup_counts(placed), **_combinations(rows)}


def aggregates_of_sides(rows: DataFrame) -> dict[str, DataFrame]:
    """The same six tables from whole side rows (those of ``side_rows``, with their event):
    each is one grouping of them, without a shuffle by event."""
    picks = A.seats(rows, ["period", "segment"])
    return {"individual": A.individual(picks), "matchup": A.faced_counts(picks.where("faced")), **_combinations(rows)}


def _combinations(rows: DataFrame) -> dict[str, DataFrame]:
    inner = A.pair_vs_pair(rows, A.INNER, "left")
    ext = A.pair_vs_pair(rows, A.EXTENDED, "inner")
    duo = A.duo_aggregate_inner(inner).unionByName(A.duo_aggregate_ext(ext))

    # durations need the members only; the extended pairs don't ask for an opponent
    inner_ids = A.fan_out(rows, A.INNER)
    member = lambda slot: F.when(F.col(slot) == "JUNGLE", F.col("jgl")).when(F.col(slot) == "MIDDLE", F.col("mid")).otherwise(F.col("sup"))
    inner_ids = inner_ids.select("period", "segment", "duration_s", "win", "roles", member("slot_a").alias("a"), member("slot_b").alias("b"))
    ext_ids = A.fan_out(rows, A.EXTENDED)
    at = lambda slot: F.element_at("own", F.col(slot))["entity"]
    ext_ids = ext_ids.select("period", "segment", "duration_s", "win", "roles", at("slot_a").alias("a"), at("slot_b").alias("b")).where("a is not null and b is not null")
    return {
        "duo": duo,
        "trio": A.trio_aggregate(rows),
        "duo_duration": A.duration_counts(inner_ids.unionByName(ext_ids), DUO_KEYS),
        "trio_duration": A.duration_counts(rows, TRIO_KEYS),
    }


def refresh(events: DataFrame, picks: DataFrame, sides: DataFrame, roles: DataFrame, periods: list[str], root: str, names: tuple[str, ...] = ("individual", "matchup", "duo", "trio", "duo_duration", "trio_duration")) -> None:
    """Rebuild the aggregates of ``periods`` and replace just these partitions of the
    tables under ``root``; a period that has no events any more has no rows then.
    Running it twice leaves the same rows."""
    roles = checkpointed(roles)
    got = build_aggregates(events, picks, checkpointed(sides), roles, periods)
    for name in names:
        refresh_partitions(got[name], f"{root}/{name}", "period", periods)


def refresh_from_sides(rows: DataFrame, periods: list[str], root: str, names: tuple[str, ...] = ("individual", "matchup", "duo", "trio", "duo_duration", "trio_duration")) -> None:
    """``refresh`` from whole side rows, which need no shuffle by event and no copy."""
    got = aggregates_of_sides(rows.where(F.col("period").isin(*periods)))
    with compiled(rows.sparkSession):
        for name in names:
            refresh_partitions(got[name], f"{root}/{name}", "period", periods)


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Within it, what would be one generated method too large for HotSpot to compile (8000
    bytes, the side rows' is) runs operator by operator, in methods that it compiles."""
    before = spark.conf.get(HUGE_METHOD, None)
    spark.conf.set(HUGE_METHOD, "8000")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(HUGE_METHOD)
        else:
            spark.conf.set(HUGE_METHOD, before)
