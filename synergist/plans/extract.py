"""Extract job: raw documents to facts, with quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract as E


def extract(detail: DataFrame, timeline: DataFrame, period: str | None = None, reliability: DataFrame | None = None) -> dict[str, DataFrame]:
    """events, picks, sides, roles, objectives and quarantine (event_id, status,
    reason).

    Documents that don't count are 'excluded'; broken structure and missing or
    foreign timelines are 'error_retryable'. Only clean events reach the facts.
    """
    reason = E.exclusion_reason(period)
    ids = timeline.select(F.col("metadata.matchId").alias("_tl")).distinct()
    seen = detail.withColumn("_id", F.col("metadata.matchId")).join(ids, F.col("_id") == F.col("_tl"), "left")
    broken = F.coalesce(E.structure_reason(), F.when(F.col("_tl").isNull(), "timeline"))
    seen = seen.withColumn("_excluded", reason).withColumn("_broken", F.when(F.col("_excluded").isNull(), broken))
    good = seen.where("_excluded is null and _broken is null").drop("_id", "_tl", "_excluded", "_broken")
    status = F.when(F.col("_excluded").isNotNull(), "excluded").otherwise("error_retryable")
    quarantine = seen.where("_excluded is not null or _broken is not null").select(F.col("_id").alias("event_id"), status.alias("status"), F.coalesce("_excluded", "_broken").alias("reason"))
    own = timeline.join(good.select(F.col("metadata.matchId").alias("_good")), F.col("metadata.matchId") == F.col("_good"), "left_semi")
    return {
        "events": E.event_rows(good),
        "picks": E.pick_rows(good),
        "sides": E.side_facts(good, own, reliability),
        "roles": E.role_facts(good, own, reliability),
        "objectives": E.objective_rows(E.log_rows(own)),
        "quarantine": quarantine,
    }


def extract_whole(docs: DataFrame, period: str | None = None, reliability: DataFrame | None = None) -> dict[str, DataFrame]:
    """events, picks, core, sides, roles, objectives and quarantine as in ``extract``, of details with
    their event's timeline in the same row (``timeline``, null without one): no join by event."""
    excluded = E.exclusion_reason(period)
    broken = F.coalesce(E.structure_reason(), F.when(F.col("timeline").isNull(), "timeline"))
    seen = docs.withColumn("_excluded", excluded).withColumn("_broken", F.when(F.col("_excluded").isNull(), broken))
    good = seen.where("_excluded is null and _broken is null").drop("_excluded", "_broken")
    status = F.when(F.col("_excluded").isNotNull(), "excluded").otherwise("error_retryable")
    quarantine = seen.where("_excluded is not null or _broken is not null").select(F.col("metadata.matchId").alias("event_id"), status.alias("status"), F.coalesce("_excluded", "_broken").alias("reason"))
    return {
        "events": E.event_rows(good),
        "picks": E.pick_rows(good),
        "core": E.whole_core(good),
        "sides": E.whole_sides(good, reliability),
        "roles": E.whole_roles(good, reliability),
        "objectives": E.whole_objectives(good),
        "quarantine": quarantine,
    }
