"""Recommended line-ups: seeds, batch completion, refinement, variants.

All line-ups of all segments and archetypes advance together: every step is a
join of their placed members with the pair scores, keyed by (segment, archetype,
seed). A line-up is a map from slot to entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import advice
from ..operators.aggregates import PAIRS, SLOTS
from ..operators.ranking import oriented, top_k, zscore
from ..sources.scratch import checkpointed

KEY = ["segment", "archetype", "seed"]
#: Axis of a profile: score column (fixed values).
AXES = {
    "synergy": "synergy",
    "scaling": "scaling",
    "cc": "cc_time_s",
    "gold": "gold_diff_15",
    "drakes": "drakes",
    "soul": "soul_rate",
    "range": "range_theoretical_pct",
    "rate": "rate",
}
#: Weights of the profiles (fixed values).
ARCHETYPES = {
    "synergy": {"synergy": 1.0},
    "winrate": {"rate": 1.0},
    "scaling": {"synergy": 0.30, "scaling": 0.385, "cc": 0.14, "gold": 0.07, "soul": 0.105},
    "early": {"synergy": 0.30, "cc": 0.175, "gold": 0.455, "drakes": 0.07},
    "objectives": {"synergy": 0.30, "scaling": 0.07, "cc": 0.245, "gold": 0.07, "drakes": 0.315},
    "range": {"synergy": 0.30, "range": 0.34, "cc": 0.12, "gold": 0.12, "drakes": 0.12},
}
#: Weights when a known opponent counts (fixed values).
COUNTER_WEIGHTS = {"matchup": 0.40, "synergy": 0.30, "scaling": 0.075, "cc": 0.075, "gold": 0.075, "drakes": 0.075}
SHORTLIST, POOL, MIN_GAMES, PARTNERS = 8, 10_000, 400, 500
MAX_SHARED = 3
NOTABLE_DELTA, NOTABLE_GAMES, PRIMARY_PICKS, SECONDARY_SLOTS = 0.03, 50.0, 3, 2
DISPLAY = ("scaling", "cc_time_s", "gold_diff_15", "rate", "ci_low", "ci_high")


def profile_table(df: DataFrame, archetypes: dict[str, dict[str, float]] = ARCHETYPES) -> DataFrame:
    """(archetype, w_<axis>...) as a table: a handful of rows."""
    rows = [(name, *(float(w.get(a, 0.0)) for a in AXES)) for name, w in archetypes.items()]
    return df.sparkSession.createDataFrame(rows, "archetype string, " + ", ".join(f"w_{a} double" for a in AXES))


def pool(duos: DataFrame, min_games: int = MIN_GAMES) -> DataFrame:
    """Reliable pairs of each segment, the first POOL by synergy."""
    return top_k(duos.where(F.col("games") >= min_games), ["segment"], [F.col("synergy").desc(), F.col("roles"), F.col("a"), F.col("b")], POOL, "_pool").drop("_pool")


def pool_moments(pairs: DataFrame) -> DataFrame:
    """m_<axis>, s_<axis> of each segment's pool (population; no spread or fewer
    than two values gives (0, 1) or deviation 1)."""
    out = []
    for a, c in AXES.items():
        few = F.count(c) < 2
        out += [F.when(few, F.lit(0.0)).otherwise(F.avg(c)).alias(f"m_{a}"), F.when(few | (F.stddev_pop(c) == 0), F.lit(1.0)).otherwise(F.stddev_pop(c)).alias(f"s_{a}")]
    return pairs.groupBy("segment").agg(*out)


def profile_score(value: dict[str, Column]) -> Column:
    """Sum of weight times z-score; null if a weighted axis is unknown."""
    total = F.lit(0.0)
    for a in AXES:
        z = (value[a] - F.col(f"m_{a}")) / F.col(f"s_{a}")
        total = total + F.when(F.col(f"w_{a}") == 0, F.lit(0.0)).otherwise(F.col(f"w_{a}") * z)
    return total


def _with_profile(rows: DataFrame, profiles: DataFrame, moments: DataFrame) -> DataFrame:
    # profiles: a handful of rows; moments: one row for each segment
    return rows.join(F.broadcast(profiles), "archetype").join(moments, "segment")


def _member(i: int) -> Column:
    return F.element_at(F.create_map(*[x for p, s in PAIRS.items() for x in (F.lit(p), F.lit(s[i]))]), F.col("roles"))


def seeds(duos: DataFrame, profiles: DataFrame, min_games: int = MIN_GAMES, shortlist: int = SHORTLIST) -> DataFrame:
    """The ``shortlist`` best pairs of each (segment, archetype) by profile score:
    KEY, placed, total (synergy so far), seed_score."""
    pairs = pool(duos, min_games)
    each = pairs.join(F.broadcast(profiles.select("archetype")))  # every pair is scored under each of the few profiles
    rows = _with_profile(each, profiles, pool_moments(pairs))
    rows = rows.withColumn("seed_score", profile_score({a: F.col(c) for a, c in AXES.items()})).where("seed_score is not null")
    rows = top_k(rows, ["segment", "archetype"], [F.col("seed_score").desc(), F.col("roles"), F.col("a"), F.col("b")], shortlist, "seed_rank")
    seed = F.concat_ws(":", "roles", "a", "b")
    return rows.select("segment", "archetype", seed.alias("seed"), F.create_map(_member(0), F.col("a"), _member(1), F.col("b")).alias("placed"), F.col("synergy").alias("total"), "seed_score")


def requested(picks: DataFrame, duos: DataFrame) -> DataFrame:
    """Line-ups from requested partial picks (KEY, slot, entity): placed and the
    synergy of the pairs among them; unknown pairs add 0 and are counted."""
    comps = picks.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("slot", "entity"))).alias("placed"))
    rows = _true_pairs(comps).join(duos.select("segment", "roles", "a", "b", "synergy"), ["segment", "roles", "a", "b"], "left")
    total = rows.groupBy(*KEY).agg(F.coalesce(F.sum("synergy"), F.lit(0.0)).alias("total"), F.count_if(F.col("synergy").isNull()).alias("unknown_pairs"))
    got = comps.join(total, KEY, "left").na.fill({"total": 0.0, "unknown_pairs": 0})
    return got.withColumn("seed_score", F.lit(None).cast("double"))


def _true_pairs(comps: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row for each slot pair whose two slots are filled."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("roles"), F.element_at("placed", F.lit(s[0])).alias("a"), F.element_at("placed", F.lit(s[1])).alias("b")) for p, s in PAIRS.items()]))
    return comps.select(*KEY, *(extra or []), each.alias("p")).select(*KEY, *(extra or []), "p.*").where("a is not null and b is not null")


def partners(duos: DataFrame, min_games: int) -> DataFrame:
    """Reliable pairs seen from each member, the PARTNERS best by synergy for each
    (anchor, pair)."""
    columns = ["segment", "games", *dict.fromkeys(AXES.values())]
    rows = oriented(duos.where(F.col("games") >= min_games), columns)
    order = [F.col("synergy").desc(), F.col("games").desc(), F.col("partner")]
    return top_k(rows, ["segment", "roles", "anchor_slot", "anchor"], order, PARTNERS, "_best").drop("_best", "games")


def matchup_axis(matchups: DataFrame, enemy: DataFrame) -> DataFrame:
    """(segment, seed?, slot, partner, matchup_z): deltas of every candidate against
    the scouted opponent of a slot, z-scored among them; fewer than two
    candidates say nothing. ``enemy`` has (segment, slot, enemy)."""
    rows = matchups.select("segment", "slot", F.col("a").alias("partner"), F.col("b").alias("enemy"), "delta").join(enemy, ["segment", "slot", "enemy"])
    n = F.count("*").over(Window.partitionBy("segment", "slot", "enemy"))
    rows = zscore(rows.withColumn("_n", n).where("_n >= 2"), ["delta"], ["segment", "slot", "enemy"])
    return rows.select("segment", "slot", "partner", F.col("z_delta").alias("matchup_z"))


def _candidates(open_rows: DataFrame, pairs: DataFrame, profiles: DataFrame, moments: DataFrame, axis: DataFrame | None, axis_weight: float) -> DataFrame:
    """Candidates (KEY, slot, partner) that pair with every anchor of ``open_rows``
    (KEY, n_anchors, wanted slots, anchor_slot, anchor), with their score and
    summed synergy."""
    joined = open_rows.join(pairs, ["segment", "anchor_slot", "anchor"]).where(F.array_contains("wanted", F.col("slot")))
    stats = [F.avg(c).alias(f"v_{a}") for a, c in AXES.items()]
    got = joined.groupBy(*KEY, "slot", "partner", "n_anchors").agg(F.count("*").alias("_n"), F.sum("synergy").alias("synergy_sum"), *stats).where("_n = n_anchors")
    got = _with_profile(got, profiles, moments).withColumn("score", profile_score({a: F.col(f"v_{a}") for a in AXES})).where("score is not null")
    if axis is not None:
        got = got.join(axis, ["segment", "slot", "partner"], "left").withColumn("score", F.col("score") + F.coalesce("matchup_z", F.lit(0.0)) * axis_weight).drop("matchup_z")
    return got.select(*KEY, "slot", "partner", "synergy_sum", "score")


SLOT_ARRAY = list(SLOTS)


def _slot_no(slot: str = "slot") -> Column:
    return F.array_position(F.array(*map(F.lit, SLOT_ARRAY)), F.col(slot))


def complete_round(comps: DataFrame, pairs: DataFrame, profiles: DataFrame, moments: DataFrame, axis: DataFrame | None = None, axis_weight: float = 0.0) -> DataFrame:
    """Add to each open line-up the (slot, entity) of the best score. Line-ups that
    can't be extended go; full ones stay as they are. Ties go by slot, then
    entity."""
    full = comps.where(F.size("placed") == len(SLOTS))
    todo = comps.where(F.size("placed") < len(SLOTS))
    wanted = F.filter(F.array(*map(F.lit, SLOT_ARRAY)), lambda s: ~F.array_contains(F.map_keys("placed"), s))
    anchors = todo.select(*KEY, F.size("placed").alias("n_anchors"), wanted.alias("wanted"), F.explode("placed").alias("anchor_slot", "anchor"))
    best = top_k(_candidates(anchors, pairs, profiles, moments, axis, axis_weight), KEY, [F.col("score").desc(), _slot_no(), F.col("partner")], 1)
    grown = todo.join(best, KEY).withColumn("placed", F.map_concat("placed", F.create_map("slot", "partner"))).withColumn("total", F.col("total") + F.col("synergy_sum"))
    return full.unionByName(grown.select(*full.columns))


def complete(comps: DataFrame, duos: DataFrame, profiles: DataFrame, min_games: int = MIN_GAMES, rounds: int = 4, axis: DataFrame | None = None, axis_weight: float = 0.0) -> DataFrame:
    """Complete every line-up greedily in up to ``rounds`` rounds (3 from a pair)."""
    pairs, moments = checkpointed(partners(duos, min_games)), pool_moments(pool(duos, min_games))
    for _ in range(rounds):
        comps = checkpointed(complete_round(comps, pairs, profiles, moments, axis, axis_weight))
    return comps.where(F.size("placed") == len(SLOTS))


def full_stats(comps: DataFrame, duos: DataFrame, profiles: DataFrame, moments: DataFrame) -> DataFrame:
    """KEY, averages over the ten true pairs, min_games_eff, min_games and the
    profile score; null statistics where a pair lacks them, no row where a pair is
    unknown."""
    columns = list(dict.fromkeys([*AXES.values(), *DISPLAY]))
    rows = _true_pairs(comps).join(duos.select("segment", "roles", "a", "b", "games", "games_eff", *columns), ["segment", "roles", "a", "b"])
    whole = lambda c: F.when(F.count(c) == len(PAIRS), F.avg(c))
    got = rows.groupBy(*KEY).agg(F.count("*").alias("_n"), *(whole(c).alias(c) for c in columns), F.min("games_eff").alias("min_games_eff"), F.min("games").alias("min_games")).where(F.col("_n") == len(PAIRS)).drop("_n")
    got = _with_profile(got, profiles, moments)
    return got.withColumn("score", profile_score({a: F.col(c) for a, c in AXES.items()})).select(*KEY, *columns, "min_games_eff", "min_games", "score")


def _without(slot: str) -> Column:
    return F.map_filter("placed", lambda k, _: k != slot)


def refine(comps: DataFrame, duos: DataFrame, profiles: DataFrame, min_games: int = MIN_GAMES, locked: list[str] | None = None, axis: DataFrame | None = None, axis_weight: float = 0.0) -> DataFrame:
    """One pass over the slots in order: a member is replaced where another scores
    strictly better beside the four current others. Locked slots stay; if any of
    the ten pairs then lacks ``min_games`` the line-up is the original one."""
    pairs, moments = checkpointed(partners(duos, min_games)), pool_moments(pool(duos, min_games))
    now = comps.select("*", F.col("placed").alias("_before"), F.col("total").alias("_total"))
    for slot in SLOTS:
        if slot in (locked or []):
            continue
        others = _without(slot)
        anchors = now.select(*KEY, F.lit(len(SLOTS) - 1).alias("n_anchors"), F.array(F.lit(slot)).alias("wanted"), F.explode(others).alias("anchor_slot", "anchor"))
        found = _candidates(anchors, pairs, profiles, moments, axis, axis_weight)
        best = top_k(found, KEY, [F.col("score").desc(), F.col("partner")], 1).select(*KEY, F.col("partner").alias("_p"), F.col("score").alias("_s"), F.col("synergy_sum").alias("_y"))
        held = now.select(*KEY, F.element_at("placed", F.lit(slot)).alias("partner"))
        held = found.join(held, [*KEY, "partner"]).select(*KEY, F.col("score").alias("_hs"), F.col("synergy_sum").alias("_hy"))
        rows = now.join(best, KEY, "left").join(held, KEY, "left")
        better = F.coalesce(F.col("_s") > F.col("_hs"), F.lit(False))
        changed = F.map_concat(others, F.create_map(F.lit(slot), F.col("_p")))
        rows = rows.withColumns({"total": F.when(better, F.col("total") + F.col("_y") - F.col("_hy")).otherwise(F.col("total")), "placed": F.when(better, changed).otherwise(F.col("placed"))})
        now = checkpointed(rows.select(*comps.columns, "_before", "_total"))
    ok = _true_pairs(now).join(duos.where(F.col("games") >= min_games).select("segment", "roles", "a", "b"), ["segment", "roles", "a", "b"], "left_semi")
    ok = ok.groupBy(*KEY).agg((F.count("*") == len(PAIRS)).alias("_ok"))
    rows = now.join(ok, KEY, "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    keep = lambda new, old: F.when(F.col("_ok"), F.col(new)).otherwise(F.col(old))
    return rows.withColumns({"placed": keep("placed", "_before"), "total": keep("total", "_total")}).select(*comps.columns)


def _shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(F.map_values(a), F.map_values(b)))


def select_variants(comps: DataFrame) -> DataFrame:
    """Up to three line-ups for each (segment, archetype): the best score, the next
    best that shares at most MAX_SHARED members with it, and the most reliable of
    the rest that differ as much from both. Needs placed, score, min_games_eff."""
    group = ["segment", "archetype"]
    order = [F.col("score").desc(), F.col("seed")]
    first = top_k(comps, group, order, 1, "_r")
    rest = comps.join(first.select(*group, F.col("placed").alias("_p1"), F.col("seed").alias("_s1")), group).where("seed <> _s1")
    rest = rest.where(_shared("placed", "_p1") <= MAX_SHARED)
    second = top_k(rest, group, order, 1, "_r")
    left = rest.join(second.select(*group, F.col("placed").alias("_p2"), F.col("seed").alias("_s2")), group).where("seed <> _s2")
    third = top_k(left.where(_shared("placed", "_p2") <= MAX_SHARED), group, [F.col("min_games_eff").desc(), *order], 1, "_r")
    tag = lambda df, i, name: df.select(*comps.columns, F.lit(i).alias("variant"), F.lit(name).alias("selection"))
    return tag(first, 0, "score").unionByName(tag(second, 1, "diverse")).unionByName(tag(third, 2, "reliable"))


def distinct_variants(variants: DataFrame) -> DataFrame:
    """Of variants that hold the same members (after refinement) the first stays;
    ranks close up."""
    members = F.array_sort(F.map_values("placed"))
    rows = variants.withColumn("_m", members)
    rows = top_k(rows, ["segment", "archetype", "_m"], [F.col("variant")], 1, "_r").drop("_r", "_m")
    return rows.withColumn("suggestion_rank", F.row_number().over(Window.partitionBy("segment", "archetype").orderBy("variant")) - 1)


def rank_matchups(comps: DataFrame, matchups: DataFrame, direction: str) -> DataFrame:
    """Notable head-to-heads of each line-up: 'weak' lists opponents that do well
    against its members, 'strong' those its members do well against.

    The slot with the best delta is primary and gives up to three picks, the next
    two slots one each: KEY, kind, slot, against, pick, delta, pick_rank.
    """
    own, other = ("b", "a") if direction == "weak" else ("a", "b")
    notable = matchups.where((F.col("delta") >= NOTABLE_DELTA) & (F.col("games_eff") >= NOTABLE_GAMES))
    placed = comps.select(*KEY, F.explode("placed").alias("slot", "against"))
    rows = placed.join(notable.select("segment", "slot", F.col(own).alias("against"), F.col(other).alias("pick"), "delta"), ["segment", "slot", "against"])
    rows = top_k(rows, [*KEY, "slot"], [F.col("delta").desc(), F.col("pick")], PRIMARY_PICKS, "pick_rank")
    best = rows.where("pick_rank = 1").select(*KEY, "slot", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("delta").desc(), _slot_no())).alias("slot_rank"))
    rows = rows.join(best, [*KEY, "slot"])
    kept = rows.where(f"slot_rank = 1 or (slot_rank <= {1 + SECONDARY_SLOTS} and pick_rank = 1)")
    return kept.select(*KEY, F.when(F.col("slot_rank") == 1, "primary").otherwise("secondary").alias("kind"), "slot", "against", "pick", "delta", "slot_rank", "pick_rank")


def to_flat(comps: DataFrame) -> DataFrame:
    """One row for each member: KEY, the scalar columns, slot, entity."""
    scalars = [c for c in comps.columns if c not in (*KEY, "placed")]
    return comps.select(*KEY, *scalars, F.explode("placed").alias("slot", "entity"))


def to_nested(flat: DataFrame) -> DataFrame:
    """Line-ups from their member rows, members sorted by slot."""
    scalars = [c for c in flat.columns if c not in (*KEY, "slot", "entity")]
    return flat.groupBy(*KEY, *scalars).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("slot", "entity")))).alias("placed"))


def with_advice(stats: DataFrame) -> DataFrame:
    return stats.withColumn("advice", advice("scaling", "cc_time_s", "gold_diff_15"))


def propose(duos: DataFrame, matchups: DataFrame, min_games: int = MIN_GAMES, archetypes: dict[str, dict[str, float]] = ARCHETYPES) -> dict[str, DataFrame]:
    """Suggestions of every profile: seeds, completion, variants, refinement,
    statistics and notable head-to-heads."""
    profiles = profile_table(duos, archetypes)
    moments = pool_moments(pool(duos, min_games))
    done = complete(seeds(duos, profiles, min_games), duos, profiles, min_games, rounds=3)
    scored = done.join(full_stats(done, duos, profiles, moments).select(*KEY, "score", "min_games_eff"), KEY)
    chosen = select_variants(scored)
    better = distinct_variants(refine(chosen.drop("score", "min_games_eff"), duos, profiles, min_games))
    better = checkpointed(better)
    stats = with_advice(full_stats(better, duos, profiles, moments))
    return {
        "suggestions": better.join(stats.drop("synergy"), KEY, "left"),
        "weak": rank_matchups(better, matchups, "weak"),
        "strong": rank_matchups(better, matchups, "strong"),
    }
