"""Scores of pairs, triples and head-to-heads from stored aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import periods as P
from ..sources.scratch import checkpointed

STAT_SUMS = ["games", "wins", *(c for pair in A.STAT_PAIRS.values() for c in pair)]


def member_baseline(combos: DataFrame, individual: DataFrame, keys: list[str], members: dict[str, Column]) -> DataFrame:
    """Rates of each member of a combination under the combination's own weights.

    ``combos`` has segment, the keys and one row for each (period, weight) that
    may count; ``members`` maps a name to the member's slot (the entity is the
    column of that name). Returns the keys, base_<m> and base_n_<m>; combinations
    that miss a member's rate give no row.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), slot.alias("slot"), F.col(m).alias("entity")) for m, slot in members.items()]))
    rows = combos.select("segment", *keys, "period", "weight", each.alias("x")).select("segment", *keys, "period", "weight", "x.*")
    joined = rows.join(individual.select("segment", "period", "slot", "entity", "games", "wins"), ["segment", "period", "slot", "entity"])
    rates = P.weighted_rate(joined, ["segment", *keys, "m"])
    one = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    got = rates.groupBy("segment", *keys).agg(*(one(m, "rate").alias(f"base_{m}") for m in members), *(one(m, "games_eff").alias(f"base_n_{m}") for m in members))
    return got.dropna(subset=[f"base_{m}" for m in members])


def _scored(agg: DataFrame, individual: DataFrame, durations: DataFrame, window: DataFrame, reworks: DataFrame | None, keys: list[str], members: dict[str, Column], member_pairs: dict, range_dim: DataFrame | None, thresholds: tuple[float, float]) -> DataFrame:
    names = list(members)
    sums = [*STAT_SUMS, *(c for pair in member_pairs.values() for c in pair)]
    every = P.with_all_segment(agg, ["period", *keys], sums)
    weighted = P.cut_weights(every, names, window, reworks)
    # every consumer reads the small table of combinations, not the aggregates again
    rates = checkpointed(P.weighted_summary(weighted, ["segment", *keys], {**A.STAT_PAIRS, **member_pairs}))
    # every period of the window may hold a member's games, also one without the combination
    alive = rates.select("segment", *keys).join(F.broadcast(window.select("period")))  # at most three rows
    spread = P.cut_weights(alive, names, window, reworks).where("weight > 0")
    base = member_baseline(spread, P.with_all_segment(individual, ["period", "slot", "entity"], ["games", "wins"]), keys, members)
    per_bucket = P.with_all_segment(durations, ["period", *keys, "bucket"], ["games", "wins"])
    slope = P.scaling(P.cut_weights(per_bucket, names, window, reworks), ["segment", *keys])
    on = ["segment", *keys]
    rows = rates.join(base, on).join(slope, on, "left")
    ci = C.wilson("rate", "games_eff")
    syn = C.synergy("rate", [F.col(f"base_{m}") for m in names])
    syn_ci = C.synergy_ci("rate", "games_eff", [(F.col(f"base_{m}"), F.col(f"base_n_{m}")) for m in names])
    rows = rows.withColumns({"ci": ci, "synergy_raw": syn, "synergy_ci": syn_ci, "tier": C.tier("games_eff", *thresholds)})
    rows = rows.withColumns({"ci_low": F.col("ci.lo"), "ci_high": F.col("ci.hi"), "synergy_ci_low": F.col("synergy_ci.lo"), "synergy_ci_high": F.col("synergy_ci.hi")}).drop("ci", "synergy_ci")
    if range_dim is None:
        rows = rows.withColumn("range_theoretical_pct", F.lit(None).cast("double"))
    else:
        rows = with_range(rows, names, range_dim)
    label = window.select(F.first("label").alias("label"))
    return rows.join(F.broadcast(label))  # one row


def with_range(rows: DataFrame, members: list[str], dim: DataFrame) -> DataFrame:
    """Range score of the members in percent of the ceiling: null if the
    dimension is empty, a member without a score counts 0."""
    top = dim.agg(F.max("score").alias("_top"))
    rows = rows.join(F.broadcast(top))  # one row
    for m in members:
        rows = rows.join(dim.select(F.col("entity").alias(m), F.col("score").alias(f"_r_{m}")), m, "left")
    raw = sum((F.coalesce(F.col(f"_r_{m}"), F.lit(0.0)) for m in members), F.lit(0.0))
    return rows.withColumn("range_theoretical_pct", C.theoretical_pct(raw, len(members), "_top")).drop("_top", *(f"_r_{m}" for m in members))


def _slot_of(i: int) -> Column:
    table = F.create_map(*[x for p, s in A.PAIRS.items() for x in (F.lit(p), F.lit(s[i]))])
    return F.element_at(table, F.col("roles"))


def score_duo(duo: DataFrame, individual: DataFrame, durations: DataFrame, window: DataFrame, reworks: DataFrame | None = None, range_dim: DataFrame | None = None, thresholds: tuple[float, float] = C.TIER_THRESHOLDS) -> DataFrame:
    """Every pair of slots, per segment and for all. synergy is the raw one."""
    got = _scored(duo, individual, durations, window, reworks, ["roles", "a", "b"], {"a": _slot_of(0), "b": _slot_of(1)}, A.DUO_MEMBER_PAIRS, range_dim, thresholds)
    return got.withColumn("synergy", F.col("synergy_raw"))


def duo_prior(trios: DataFrame, duos: DataFrame, k: float = C.PRIOR_K) -> DataFrame:
    """(segment, jgl, mid, sup, prior): mean of the member pairs' synergies, each
    shrunk to 0 first; 0 where no pair is known."""
    keys = ["segment", *A.TRIO]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("roles"), F.col(x).alias("a"), F.col(y).alias("b")) for r, x, y in (("jgl_mid", "jgl", "mid"), ("jgl_sup", "jgl", "sup"), ("mid_sup", "mid", "sup"))]))
    shrunk = duos.select("segment", "roles", "a", "b", C.shrink("synergy_raw", "games_eff", 0.0, k).alias("s"))
    pairs = trios.select(*keys, each.alias("p")).select(*keys, "p.*").join(shrunk, ["segment", "roles", "a", "b"], "left")
    return pairs.groupBy(*keys).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("prior"))


def score_trio(trio: DataFrame, individual: DataFrame, durations: DataFrame, duos: DataFrame, window: DataFrame, reworks: DataFrame | None = None, range_dim: DataFrame | None = None, k: float = C.PRIOR_K, thresholds: tuple[float, float] = C.TIER_THRESHOLDS) -> DataFrame:
    """Every triple: synergy shrunk to the prior of its three pairs. The interval
    is the one of the raw synergy."""
    members = {m: F.lit(slot) for m, slot in A.TRIO.items()}
    got = _scored(trio, individual, durations, window, reworks, list(A.TRIO), members, A.TRIO_MEMBER_PAIRS, range_dim, thresholds)
    prior = duo_prior(got, duos, k)
    got = got.join(prior, ["segment", *A.TRIO])
    return got.withColumn("synergy", C.shrink("synergy_raw", "games_eff", "prior", k))


def score_versus(counts: DataFrame, trio: DataFrame, window: DataFrame, other: str, effect: str, reworks: DataFrame | None = None, k: float = C.PRIOR_K, thresholds: tuple[float, float] = C.TIER_THRESHOLDS) -> DataFrame:
    """Triples against an opponent or beside an ally (column ``other`` in ``slot``): the
    weighted rate above the triple's own over the same window, as <effect>_raw and shrunk
    to 0 as <effect>. ``counts`` comes from ``combo_vs_entity`` or ``combo_with_ally``,
    ``trio`` has the triples' own games and wins."""
    own, keys = list(A.TRIO), [*A.TRIO, "slot", other]
    rate = lambda df, by: P.weighted_rate(P.cut_weights(P.with_all_segment(df, ["period", *by], ["games", "wins"]), own, window, reworks), ["segment", *by])
    base = rate(trio, own).select("segment", *own, F.col("rate").alias("base"))
    rows = rate(counts, keys).join(base, ["segment", *own])
    ci, raw = C.wilson("rate", "games_eff"), F.col("rate") - F.col("base")
    return rows.select(
        "segment", *keys, "games", "games_eff", "rate", raw.alias(f"{effect}_raw"), C.shrink(raw, "games_eff", 0.0, k).alias(effect),
        ci["lo"].alias("ci_low"), ci["hi"].alias("ci_high"), C.tier("games_eff", *thresholds).alias("tier"),
    )


def score_matchup(matchup: DataFrame, individual: DataFrame, window: DataFrame, reworks: DataFrame | None = None, k: float = C.PRIOR_K, thresholds: tuple[float, float] = C.TIER_THRESHOLDS) -> DataFrame:
    """Same-slot head-to-heads: rate of a against b above a's own, shrunk to 0.
    The baseline of a follows the pair's weights."""
    keys = ["slot", "a", "b"]
    every = P.with_all_segment(matchup, ["period", *keys], ["games", "wins"])
    rates = P.weighted_rate(P.cut_weights(every, ["a", "b"], window, reworks), ["segment", *keys])
    alive = rates.select("segment", *keys).join(F.broadcast(window.select("period")))  # at most three rows
    spread = P.cut_weights(alive, ["a", "b"], window, reworks).where("weight > 0")
    every_one = P.with_all_segment(individual, ["period", "slot", "entity"], ["games", "wins"])
    base = P.weighted_rate(spread.join(every_one.withColumnRenamed("entity", "a"), ["segment", "period", "slot", "a"]), ["segment", *keys])
    rows = rates.join(base.select("segment", *keys, F.col("rate").alias("base")), ["segment", *keys])
    ci = C.wilson("rate", "games_eff")
    raw = F.col("rate") - F.col("base")
    label = window.select(F.first("label").alias("label"))
    return rows.select(
        "segment", *keys, "games", "games_eff", "rate", raw.alias("delta_raw"), C.shrink(raw, "games_eff", 0.0, k).alias("delta"),
        ci["lo"].alias("ci_low"), ci["hi"].alias("ci_high"), C.tier("games_eff", *thresholds).alias("tier"),
    ).join(F.broadcast(label))
