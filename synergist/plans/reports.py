"""Reports: resilience, off-slot picks, detail of a combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import deviation, per_minute
from ..operators import aggregates as A
from ..operators import ranking as R
from ..operators.filters import segment_filter, side_bounds

FACTORS = ["team_gold_diff_15", "jgl_cs_diff_15", "first_blood_team"]
ZONES = {"team_gold_diff_15": 1000.0}


def resilience_rows(roles: DataFrame, sides: DataFrame) -> DataFrame:
    """Role rows of complete events with the three early factors of their side."""
    gold = A.team_gold(A.wide_sides(roles))
    cs = A.require(sides.select("event_id", "side", "jgl_cs_diff_15"), ["jgl_cs_diff_15"])
    picks = roles.select("event_id", "side", "slot", "entity", "win")
    return picks.join(gold, ["event_id", "side"]).join(cs, ["event_id", "side"]).join(A.first_blood(roles), ["event_id", "side"])


def resilience(roles: DataFrame, sides: DataFrame, min_rows: int = 200) -> DataFrame:
    """Games and wins when ahead and behind by (slot, entity, factor); no rows at
    all below ``min_rows`` observations."""
    rows = resilience_rows(roles, sides)
    n = rows.agg(F.count("*").alias("_rows"))
    table = A.ahead_behind(rows, FACTORS, ZONES)
    return table.join(F.broadcast(n)).where(F.col("_rows") >= min_rows).drop("_rows")  # one row


def resilience_report(table: DataFrame, min_side: int, bounds: dict) -> tuple[DataFrame, DataFrame]:
    """Filtered table with rates on both sides and their gap, and the count before
    the bounds."""
    return side_bounds(table, min_side, bounds)


def flex(individual: DataFrame, roles: DataFrame, segment: str | None = None, min_games: int = 30, established: int = 100, share: float = 0.05) -> DataFrame:
    """Entities played off their primary slot: how often, how well, and how their
    resources there differ from the slot's baseline and from their primary slot.

    A pick is established with ``established`` games and ``share`` of the entity's
    games.
    """
    dist = A.slot_distribution(segment_filter(individual, segment), min_games)
    total = dist.groupBy("entity").agg(F.sum("games").alias("_all"))
    dist = dist.join(total, "entity").withColumn("share", F.col("games") / F.col("_all")).drop("_all")
    primary = R.primary_slot(dist.select("entity", "slot", "games")).select("entity", "primary_slot")
    profile = A.resource_profile(segment_filter(roles, segment), ["slot", "entity"], min_games)
    base = A.resource_profile(segment_filter(roles, segment), ["slot"]).select("slot", F.col("avg_gold_15").alias("_bg"), F.col("avg_dmg_per_gold").alias("_bd"))
    home = profile.select("entity", F.col("slot").alias("primary_slot"), F.col("avg_gold_15").alias("_hg"), F.col("avg_dmg_per_gold").alias("_hd"))
    rows = dist.join(primary, "entity").where("slot <> primary_slot").join(profile.drop("n"), ["slot", "entity"], "left").join(base, "slot", "left").join(home, ["entity", "primary_slot"], "left")
    return rows.select(
        "entity", "slot", "primary_slot", "games", "wins", "share", "avg_gold_15", "avg_dmg_per_gold",
        deviation("avg_gold_15", "_bg").alias("gold_vs_slot"), deviation("avg_dmg_per_gold", "_bd").alias("dmg_vs_slot"),
        deviation("avg_gold_15", "_hg").alias("gold_vs_primary"), deviation("avg_dmg_per_gold", "_hd").alias("dmg_vs_primary"),
        ((F.col("games") >= established) & (F.col("share") >= share)).alias("established"),
    )


def summary_columns(available: list[str]) -> list[Column]:
    """Aggregates of the detail report over rows with a weight: weighted means per
    row (not per aggregate), per-minute means, valid counts and conditional rates,
    for whichever stat columns exist."""
    w = F.col("weight")

    def mean(value: Column, ok: Column | None = None) -> Column:
        known = value.isNotNull() if ok is None else value.isNotNull() & ok
        den = F.sum(F.when(known, w))
        return F.when(den > 0, F.sum(F.when(known, w * value.cast("double"))) / den)

    win = F.col("win").cast("int")
    out = [F.count("*").alias("games"), mean(win).alias("rate")]
    for m in (5, 10, 15, 20, 25, 30, 35):
        if (c := f"gold_diff_{m}") in available:
            out += [mean(F.col(c)).alias(c), F.count(c).alias(f"{c}_n")]
    # stat columns of the schema (fixed values)
    plain = [
        "grubs_taken", "herald_taken", "soul_taken", "nashor_first", "nashor_first_s", "first_tower", "towers_destroyed", "plates_taken",
        "first_blood_trio", "kill_participation_pre15", "damage_share", "a_kp_pre15", "b_kp_pre15", "jgl_dmg_per_gold", "mid_dmg_per_gold",
        "sup_dmg_per_gold", "jgl_cs_diff_15", "a_dmg_per_gold", "b_dmg_per_gold",
    ]
    out += [mean(F.col(c).cast("double")).alias(c) for c in plain if c in available]
    rates = ["vision_score", "drakes_taken", "cc_time_s", "jgl_cc_time_s", "mid_cc_time_s", "sup_cc_time_s", "wards_placed", "wards_killed", "a_cc_time_s", "b_cc_time_s"]
    out += [mean(F.when(F.col("duration_s") > 0, per_minute(c, "duration_s"))).alias(c) for c in rates if c in available]
    if "soul_taken" in available:
        out += [mean(win, F.col("soul_taken")).alias("rate_with_soul"), mean(win, ~F.col("soul_taken")).alias("rate_without_soul")]
    return out + [mean(F.col("duration_s"), F.col("win")).alias("avg_duration_win_s"), mean(F.col("duration_s"), ~F.col("win")).alias("avg_duration_loss_s")]


def summarize(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Detail summary of each key from rows of positive weight."""
    return rows.where("weight > 0").groupBy(*keys).agg(*summary_columns(rows.columns))


def pair_rows(rows: DataFrame) -> DataFrame:
    """Role rows (own_a, own_b of a fan-out) as rows for the summary of slot pairs."""
    return rows.select(
        "period", "segment", "duration_s", "win", "roles", F.col("own_a.entity").alias("a"), F.col("own_b.entity").alias("b"),
        F.col("own_a.cc_time_s").alias("a_cc_time_s"), F.col("own_b.cc_time_s").alias("b_cc_time_s"),
    )


def detail(rows: DataFrame, window: DataFrame, keys: dict[str, object], segment: str | None = None) -> DataFrame:
    """Summary of one entity, pair or combination (its key columns and values)."""
    rows = segment_filter(rows, segment)
    for c, v in keys.items():
        rows = rows.where(F.col(c) == v)
    return summarize(rows.join(F.broadcast(window.select("period", "weight")), "period"), list(keys))  # at most three rows
