"""Additive aggregates per (period, segment, combination).

Facts: ``events`` (event_id, period, segment, duration_s), ``roles`` (event_id,
side, slot, entity, win, gold_5/10/15, cc_time_s, vision_score, ...) with one row
for each slot of each side, and ``sides`` (event_id, side, win, jgl, mid, sup and
side-wide stats). Every stat is kept as a (sum, n) pair, so rows stay additive.

Opponents are found without self-joins: one shuffle by event brings the ten role
rows of an event together in two wide rows, one for each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_true, count_true, duration_bucket, per_minute

SLOTS = ("TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY")
#: Slot pairs by name (fixed values).
PAIRS = {
    "jgl_mid": ("JUNGLE", "MIDDLE"),
    "jgl_sup": ("JUNGLE", "UTILITY"),
    "mid_sup": ("MIDDLE", "UTILITY"),
    "top_jgl": ("TOP", "JUNGLE"),
    "top_mid": ("TOP", "MIDDLE"),
    "top_bot": ("TOP", "BOTTOM"),
    "top_sup": ("TOP", "UTILITY"),
    "jgl_bot": ("JUNGLE", "BOTTOM"),
    "mid_bot": ("MIDDLE", "BOTTOM"),
    "bot_sup": ("BOTTOM", "UTILITY"),
}
INNER = ("jgl_mid", "jgl_sup", "mid_sup")
EXTENDED = tuple(p for p in PAIRS if p not in INNER)
TRIO = {"jgl": "JUNGLE", "mid": "MIDDLE", "sup": "UTILITY"}

MINUTES = (5, 10, 15)
#: Score column: (sum column, n column); the names are the schema (fixed values).
STAT_PAIRS = {
    "gold_diff_5": ("gold5_sum", "gold5_n"),
    "gold_diff_10": ("gold10_sum", "gold10_n"),
    "gold_diff_15": ("gold15_sum", "gold15_n"),
    "team_gold_diff_15": ("team_gold15_sum", "team_gold15_n"),
    "vision_score": ("vision_sum", "vision_n"),
    "drakes": ("drakes_sum", "drakes_n"),
    "soul_rate": ("soul_sum", "soul_n"),
    "herald_rate": ("herald_sum", "herald_n"),
    "first_tower_rate": ("tower1_sum", "tower1_n"),
    "cc_time_s": ("cc_sum", "cc_n"),
}
DUO_MEMBER_PAIRS = {"a_cc_time_s": ("a_cc_sum", "a_cc_n"), "b_cc_time_s": ("b_cc_sum", "b_cc_n")}
TRIO_MEMBER_PAIRS = {f"{m}_cc_time_s": (f"{m}_cc_sum", f"{m}_cc_n") for m in TRIO}


def with_event(df: DataFrame, events: DataFrame) -> DataFrame:
    """Facts with their event's period, segment and duration."""
    return df.join(events.select("event_id", "period", "segment", "duration_s"), "event_id")


def individual(picks: DataFrame) -> DataFrame:
    """Games and wins of each (period, segment, slot, entity)."""
    return picks.groupBy("period", "segment", "slot", "entity").agg(F.count("*").alias("games"), count_true("win").alias("wins"))


def opponents(picks: DataFrame, columns: list[str]) -> DataFrame:
    """Each role row beside the other side's row of the same slot (enemy_*).

    Slots that only one side fields give no row.
    """
    row = F.struct("side", *columns)
    both = picks.groupBy("event_id", "slot").agg(F.min(row).alias("a"), F.max(row).alias("b")).where("a.side <> b.side")
    each = F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("enemy")), F.struct(F.col("b").alias("own"), F.col("a").alias("enemy"))))
    flat = both.select("event_id", "slot", each.alias("p"))
    return flat.select("event_id", "slot", "p.own.*", *(F.col(f"p.enemy.{c}").alias(f"enemy_{c}") for c in columns))


def matchup_counts(picks: DataFrame) -> DataFrame:
    """Games and wins of a against b, from both perspectives."""
    return faced_counts(opponents(picks, ["entity", "win", "period", "segment"]))


def faced_counts(faced: DataFrame) -> DataFrame:
    """The same from picks beside the one they face (``enemy_entity``)."""
    keys = ["period", "segment", "slot", F.col("entity").alias("a"), F.col("enemy_entity").alias("b")]
    return faced.groupBy(*keys).agg(F.count("*").alias("games"), count_true("win").alias("wins"))


ROLE_STATS = ("entity", "win", "gold_5", "gold_10", "gold_15", "cc_time_s", "vision_score")


def wide_sides(roles: DataFrame, stats: tuple[str, ...] = ROLE_STATS) -> DataFrame:
    """(event_id, side, own, enemy): maps from slot to the role row, the second
    empty where no other side is there. An event has at most ten role rows."""
    entry = F.struct(F.col("slot"), F.struct(*stats).alias("v"))
    own = roles.repartition("event_id").groupBy("event_id", "side").agg(F.map_from_entries(F.collect_list(entry)).alias("own"))
    both = own.groupBy("event_id").agg(F.collect_list(F.struct("side", "own")).alias("s"))
    each = both.select("event_id", F.explode("s").alias("x"), "s").select(
        "event_id", "x.side", "x.own", F.get(F.filter("s", lambda o: o["side"] != F.col("x.side")), F.lit(0))["own"].alias("enemy")
    )
    return each


def seats(wide: DataFrame, columns: list[str], stats: tuple[str, ...] = ("entity", "win"), faced: tuple[str, ...] = ("entity",)) -> DataFrame:
    """The own role rows of wide sides again: ``columns``, slot, ``stats``, whether the
    other side fields the slot, and what it has there (enemy_*)."""
    rows = wide.select(*columns, F.explode("own").alias("slot", "_v"), "enemy")
    foe = F.element_at("enemy", F.col("slot"))
    return rows.select(*columns, "slot", *(F.col(f"_v.{c}").alias(c) for c in stats), foe.isNotNull().alias("faced"), *(foe[c].alias(f"enemy_{c}") for c in faced))


def _slot(m: str, slot: str | Column) -> Column:
    return F.element_at(m, F.lit(slot) if isinstance(slot, str) else slot)


def team_gold_column() -> Column:
    """Side's gold lead at 15 over all five slots of a wide row; null unless all
    five are known on both sides."""
    diffs = [_slot("own", s)["gold_15"] - _slot("enemy", s)["gold_15"] for s in SLOTS]
    total = diffs[0]
    for d in diffs[1:]:
        total = total + d
    return total


def team_gold(wide: DataFrame) -> DataFrame:
    """(event_id, side, team_gold_diff_15) of the complete sides."""
    return complete_only(wide.select("event_id", "side", team_gold_column().alias("team_gold_diff_15")), ["team_gold_diff_15"])


def complete_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every column known."""
    return df.dropna(subset=columns)


def _pair(total: Column, counted: Column, name: str) -> list[Column]:
    s, n = STAT_PAIRS[name] if name in STAT_PAIRS else (f"{name}_sum", f"{name}_n")
    return [F.sum(total).alias(s), F.count(counted).alias(n)]


def _objectives() -> list[Column]:
    """Side-level objectives, never attributable to members."""
    flag = lambda c, name: [count_true(c).alias(STAT_PAIRS[name][0]), F.count(c).alias(STAT_PAIRS[name][1])]
    return [
        *_pair(per_minute("drakes_taken", "duration_s"), F.col("drakes_taken"), "drakes"),
        *flag("soul_taken", "soul_rate"),
        *flag("herald_taken", "herald_rate"),
        *flag("first_tower", "first_tower_rate"),
        *_pair(F.col("team_gold_diff_15"), F.col("team_gold_diff_15"), "team_gold_diff_15"),
    ]


def _outcome() -> list[Column]:
    return [F.count("*").alias("games"), count_true("win").alias("wins")]


def trio_aggregate(sides: DataFrame) -> DataFrame:
    """Aggregate of each (period, segment, jgl, mid, sup) from side rows that
    have their event and team_gold_diff_15."""
    stats = [x for m in MINUTES for x in _pair(F.col(f"gold_diff_{m}"), F.col(f"gold_diff_{m}"), f"gold_diff_{m}")]
    stats += [x for c in ("vision_score", "cc_time_s") for x in _pair(per_minute(c, "duration_s"), F.col(c), c)]
    stats += [x for m in TRIO for x in (F.sum(per_minute(f"{m}_cc_time_s", "duration_s")).alias(f"{m}_cc_sum"), F.count(f"{m}_cc_time_s").alias(f"{m}_cc_n"))]
    return sides.groupBy("period", "segment", *TRIO).agg(*_outcome(), *stats, *_objectives())


def fan_out(sides: DataFrame, pairs: tuple[str, ...]) -> DataFrame:
    """One row for each named slot pair of a side: roles, slot_a, slot_b."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("roles"), F.lit(PAIRS[p][0]).alias("slot_a"), F.lit(PAIRS[p][1]).alias("slot_b")) for p in pairs]))
    return sides.withColumn("_p", each).select("*", "_p.*").drop("_p")


def pair_vs_pair(wide: DataFrame, pairs: tuple[str, ...], how: str = "left") -> DataFrame:
    """Fan a wide side out to slot pairs with the two own rows (own_a, own_b) and the
    two facing ones (foe_a, foe_b). 'inner' keeps pairs with all four, 'left' keeps all."""
    rows = fan_out(wide, pairs)
    rows = rows.withColumns({n: _slot(m, F.col(s)) for n, m, s in (("own_a", "own", "slot_a"), ("own_b", "own", "slot_b"), ("foe_a", "enemy", "slot_a"), ("foe_b", "enemy", "slot_b"))})
    if how == "inner":
        rows = rows.where("own_a is not null and own_b is not null and foe_a is not null and foe_b is not null")
    return rows


def _pair_gold(m: int) -> Column:
    total = lambda who: F.col(f"{who}_a.gold_{m}") + F.col(f"{who}_b.gold_{m}")
    return total("own") - total("foe")


def duo_aggregate_inner(rows: DataFrame) -> DataFrame:
    """The three pairs inside the trio: pair-specific stats where role rows exist,
    the side-wide ones otherwise.

    Known quirk, kept: n of vision and control counts the side-wide column, not
    the value that was summed.
    """
    member = lambda slot: F.when(F.col(slot) == "JUNGLE", F.struct(F.col("jgl").alias("e"), F.col("jgl_cc_time_s").alias("cc"))).when(F.col(slot) == "MIDDLE", F.struct(F.col("mid").alias("e"), F.col("mid_cc_time_s").alias("cc"))).otherwise(F.struct(F.col("sup").alias("e"), F.col("sup_cc_time_s").alias("cc")))
    rows = rows.withColumn("_a", member("slot_a")).withColumn("_b", member("slot_b"))
    stats = []
    for m in MINUTES:
        gold = F.coalesce(_pair_gold(m), F.col(f"gold_diff_{m}"))
        stats += _pair(gold, gold, f"gold_diff_{m}")
    for c in ("vision_score", "cc_time_s"):
        stats += _pair(per_minute(F.coalesce(F.col(f"own_a.{c}") + F.col(f"own_b.{c}"), F.col(c)), "duration_s"), F.col(c), c)
    for x in ("a", "b"):
        stats += [F.sum(per_minute(F.col(f"_{x}.cc"), "duration_s")).alias(f"{x}_cc_sum"), F.count(F.col(f"_{x}.cc")).alias(f"{x}_cc_n")]
    keys = ["period", "segment", "roles", F.col("_a.e").alias("a"), F.col("_b.e").alias("b")]
    return rows.groupBy(*keys).agg(*_outcome(), *stats, *_objectives())


def duo_aggregate_ext(rows: DataFrame) -> DataFrame:
    """The seven other pairs, from role rows of both sides (rows of an 'inner'
    fan-out). Known quirk, kept: n of vision and control counts rows."""
    stats = []
    for m in MINUTES:
        stats += _pair(_pair_gold(m), _pair_gold(m), f"gold_diff_{m}")
    for c in ("vision_score", "cc_time_s"):
        stats += _pair(per_minute(F.col(f"own_a.{c}") + F.col(f"own_b.{c}"), "duration_s"), F.lit(1), c)
    for x in ("a", "b"):
        stats += [F.sum(per_minute(F.col(f"own_{x}.cc_time_s"), "duration_s")).alias(f"{x}_cc_sum"), F.count(F.col(f"own_{x}.cc_time_s")).alias(f"{x}_cc_n")]
    keys = ["period", "segment", "roles", F.col("own_a.entity").alias("a"), F.col("own_b.entity").alias("b")]
    return rows.groupBy(*keys).agg(*_outcome(), *stats, *_objectives())


def duration_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Games and wins by combination and five-minute bucket of duration."""
    return rows.groupBy("period", "segment", *keys, duration_bucket("duration_s").alias("bucket")).agg(*_outcome())


def combo_vs_entity(sides: DataFrame, picks: DataFrame) -> DataFrame:
    """Each combination against each opposing entity: games and wins."""
    # the picks of an event, at most ten, meet its sides as one row
    seats = picks.groupBy("event_id").agg(F.collect_list(F.struct(F.col("side").alias("_s"), "slot", F.col("entity").alias("enemy"))).alias("_seats"))
    faced = F.explode(F.filter("_seats", lambda p: p["_s"] != F.col("side"))).alias("_p")
    rows = sides.join(seats, "event_id").select("period", "segment", *TRIO, "win", faced).select("*", "_p.slot", "_p.enemy")
    return rows.groupBy("period", "segment", *TRIO, "slot", "enemy").agg(*_outcome())


def combo_with_ally(sides: DataFrame, picks: DataFrame) -> DataFrame:
    """Each combination with each ally outside it: games and wins."""
    ally = picks.where(~F.col("slot").isin(*TRIO.values())).select("event_id", "side", "slot", F.col("entity").alias("ally"))
    return sides.join(ally, ["event_id", "side"]).groupBy("period", "segment", *TRIO, "slot", "ally").agg(*_outcome())


def ahead_behind(rows: DataFrame, factors: list[str], zones: dict[str, float]) -> DataFrame:
    """Games and wins when ahead and when behind, by (slot, entity, factor).

    Factors are unpivoted as numbers (a boolean is ahead when true); values
    inside a factor's neutral zone are left out.
    """
    value = lambda f: F.when(F.col(f).cast("double").isNotNull(), F.col(f).cast("double"))
    kinds = dict(rows.dtypes)
    each = []
    for f in factors:
        ahead = F.col(f) if kinds[f] == "boolean" else F.col(f) >= 0
        keep = F.lit(True) if kinds[f] == "boolean" or not zones.get(f) else F.abs(value(f)) >= zones[f]
        each.append(F.struct(F.lit(f).alias("factor"), F.when(keep, ahead).alias("ahead")))
    flat = rows.select("slot", "entity", "win", F.explode(F.array(*each)).alias("x")).select("slot", "entity", "win", "x.*").where("ahead is not null")
    return flat.groupBy("slot", "entity", "factor").agg(
        count_true("ahead").alias("games_ahead"),
        F.count_if(F.col("ahead") & F.col("win")).alias("wins_ahead"),
        F.count_if(~F.col("ahead")).alias("games_behind"),
        F.count_if(~F.col("ahead") & F.col("win")).alias("wins_behind"),
    )


def resource_profile(roles: DataFrame, keys: list[str], min_games: int = 0) -> DataFrame:
    """Mean gold at 15 and damage per gold over rows that have gold at 15."""
    got = require(roles, ["gold_15"]).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("gold_15").alias("avg_gold_15"), F.avg("dmg_per_gold").alias("avg_dmg_per_gold"))
    return min_support(got, min_games, "n") if min_games else got


def slot_distribution(rates: DataFrame, min_games: int = 1) -> DataFrame:
    """Games and wins by (entity, slot) from individual rates."""
    return min_support(rates.groupBy("entity", "slot").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins")), min_games)


def min_support(df: DataFrame, n: int, column: str = "games") -> DataFrame:
    return df.where(F.col(column) >= n)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def entity_average(picks: DataFrame, column: str, min_n: int) -> DataFrame:
    """Average of a column by entity, over its known values, with support."""
    got = picks.where(F.col(column).isNotNull()).groupBy("entity").agg(F.count("*").alias("n"), F.avg(column).alias("value"))
    return min_support(got, min_n, "n")


def first_blood(roles: DataFrame) -> DataFrame:
    """Whether any member of a side has first blood; unknown counts as no."""
    return roles.groupBy("event_id", "side").agg(any_true("first_blood").alias("first_blood_team"))


def with_group_total(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """Add the total of ``column`` over the group, pre-aggregated and joined."""
    return df.join(df.groupBy(*by).agg(F.sum(column).alias(name)), by)


def ingest_status(events: DataFrame, journal: DataFrame, days: int = 7) -> DataFrame:
    """Counts by day and segment over the last ``days`` days, by period and by
    journal status, and the newest time: (metric, key, key2, n, at)."""
    newest = events.agg(F.max("created").alias("_top"))
    recent = events.join(F.broadcast(newest)).where(F.col("created") > F.col("_top") - F.make_interval(days=F.lit(days)))  # one row
    none = F.lit(None).cast("string")
    at = F.lit(None).cast("timestamp")
    per_day = recent.groupBy(F.date_format("created", "yyyy-MM-dd").alias("key"), F.col("segment").alias("key2")).agg(F.count("*").alias("n")).select(F.lit("day").alias("metric"), "key", "key2", "n", at.alias("at"))
    per_period = events.groupBy(F.col("period").alias("key")).agg(F.count("*").alias("n"), F.max("created").alias("at")).select(F.lit("period").alias("metric"), "key", none.alias("key2"), "n", "at")
    per_status = journal.groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n")).select(F.lit("status").alias("metric"), "key", none.alias("key2"), "n", at.alias("at"))
    return per_day.unionByName(per_period).unionByName(per_status)


def windows(scores: DataFrame) -> DataFrame:
    return scores.select("label").distinct()


def segments(scores: DataFrame) -> DataFrame:
    """Segments by volume, largest first."""
    return scores.groupBy("segment").agg(F.sum("games").alias("games")).orderBy(F.col("games").desc(), "segment")


def daily_pivot(events: DataFrame, segment_values: list[str] | None = None) -> DataFrame:
    """Counts by day, a column for each segment, missing cells 0."""
    day = events.select(F.date_format("created", "yyyy-MM-dd").alias("day"), "segment")
    grouped = day.groupBy("day")
    pivoted = grouped.pivot("segment", segment_values) if segment_values else grouped.pivot("segment")
    return pivoted.count().na.fill(0)
