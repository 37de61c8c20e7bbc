"""Registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import models as M
from ..operators import aggregates as A
from ..operators import extract as E
from ..operators import filters, joins
from ..operators import periods as P
from ..operators import ranking as R
from ..operators import reference as ref
from ..sources import sinks
from ..sources.scratch import checkpointed
from . import compose, factors, reports, scores
from .aggregates import DUO_KEYS, TRIO_KEYS, aggregates_of_sides, side_rows
from .views import facts, table, whole_sides

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (negative zero folded), so that engines compare."""
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _m(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "m")


def _p(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "p")


def _t(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "t")


def _window(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(P.make_window(_m(spark, d)))


def _side_rows(spark: SparkSession, d: str) -> DataFrame:
    return whole_sides(spark, d)


def _within(df: DataFrame, window: DataFrame) -> DataFrame:
    """Facts of a window's periods: what has no weight isn't read into its scores."""
    return df.where(F.col("period").isin([r.period for r in window.select("period").collect()]))  # at most three


def _aggregates(spark: SparkSession, d: str, names: tuple[str, ...] = ("individual", "duo", "trio", "duo_duration", "trio_duration"), window: DataFrame | None = None) -> dict[str, DataFrame]:
    """Aggregate tables, of all periods or of a window's, each computed once and stored as
    the scores expect them."""
    rows = _side_rows(spark, d)
    got = aggregates_of_sides(rows if window is None else _within(rows, window))
    return {k: checkpointed(got[k]) for k in names}


# ------------------------------------------------------------ natural view


@query
def basket_synergy(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of brands in one order and how completed orders go with them: the 50
    best synergies with Wilson intervals, recent years weighing most."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    place = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("segment"))
    events = orders.join(place, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("event_id"), "segment", F.concat(F.year("o_orderdate"), F.lit(".1")).alias("period"), (F.col("o_orderstatus") == "F").alias("win"))
    slots = R.top_k(lines, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")], 1)
    picks = slots.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("slot"), F.col("p_brand").alias("entity"))
    picks = picks.join(events, "event_id")
    window = P.make_window(events)
    lone = P.weighted_rate(P.cut_weights(A.individual(picks), ["entity"], window), ["slot", "entity"])
    basket = picks.groupBy("event_id", "period", "win").agg(F.array_sort(F.collect_list(F.struct("slot", "entity"))).alias("s"))  # at most seven
    both = basket.select("period", "win", F.explode("s").alias("x"), "s").select("period", "win", "x", F.explode(F.filter("s", lambda y: y["slot"] > F.col("x.slot"))).alias("y"))
    keys = ["slot_a", "slot_b", "a", "b"]
    pairs = both.select("period", "win", F.col("x.slot").alias("slot_a"), F.col("y.slot").alias("slot_b"), F.col("x.entity").alias("a"), F.col("y.entity").alias("b"))
    counts = pairs.groupBy("period", *keys).agg(F.count("*").alias("games"), C.count_true("win").alias("wins"))
    rows = P.weighted_rate(P.cut_weights(counts, ["a", "b"], window), keys)
    for x in "ab":
        rows = rows.join(lone.select(F.col("slot").alias(f"slot_{x}"), F.col("entity").alias(x), F.col("rate").alias(f"rate_{x}")), [f"slot_{x}", x])
    ci = C.wilson("rate", "games_eff")
    got = rows.select(*keys, "games", "games_eff", "rate", ci["lo"].alias("ci_low"), ci["hi"].alias("ci_high"), C.synergy("rate", ["rate_a", "rate_b"]).alias("synergy"), C.tier("games_eff", 3, 6).alias("tier"))
    return rounded(R.order_by(rounded(got), ["synergy", "games"], ["desc", "desc"], keys).limit(50))


# ------------------------------------------------------------ aggregates


@query
def individual_rates(spark: SparkSession, d: str) -> DataFrame:
    return A.individual(_p(spark, d))


@query
def matchups(spark: SparkSession, d: str) -> DataFrame:
    return A.matchup_counts(_p(spark, d))


@query
def team_gold(spark: SparkSession, d: str) -> DataFrame:
    return A.team_gold(A.wide_sides(_p(spark, d)))


@query
def duo_agg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.duo_aggregate_inner(A.pair_vs_pair(_side_rows(spark, d), A.INNER, "left")), 4)


@query
def pair_gold_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The inner pairs where a fifth of the events have no role rows."""
    roles = _p(spark, d).where("event_id % 5 <> 0").drop("period", "segment", "duration_s")
    rows = side_rows(_t(spark, d), roles, _m(spark, d))
    got = A.duo_aggregate_inner(A.pair_vs_pair(rows, A.INNER, "left"))
    return rounded(got.select("period", "segment", *DUO_KEYS, "games", "gold10_sum", "gold10_n", "gold15_sum", "gold15_n", "vision_sum", "vision_n", "team_gold15_n"), 4)


@query
def duo_agg_ext(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.duo_aggregate_ext(A.pair_vs_pair(_side_rows(spark, d), A.EXTENDED, "inner")), 4)


@query
def trio_agg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.trio_aggregate(_side_rows(spark, d)), 4)


@query
def duration_counts(spark: SparkSession, d: str) -> DataFrame:
    got = _aggregates(spark, d, ("duo_duration", "trio_duration"))
    trio = got["trio_duration"].select("period", "segment", F.lit("trio").alias("roles"), F.col("jgl").alias("a"), F.col("mid").alias("b"), F.col("sup").alias("c"), "bucket", "games", "wins")
    duo = got["duo_duration"].select("period", "segment", "roles", "a", "b", F.lit(None).cast("long").alias("c"), "bucket", "games", "wins")
    return trio.unionByName(duo)


@query
def combo_vs_enemy(spark: SparkSession, d: str) -> DataFrame:
    return A.combo_vs_entity(_t(spark, d), _p(spark, d))


@query
def combo_with_ally(spark: SparkSession, d: str) -> DataFrame:
    return A.combo_with_ally(_t(spark, d), _p(spark, d))


@query
def group_total(spark: SparkSession, d: str) -> DataFrame:
    """Damage share of each role row in its side's total."""
    rows = A.with_group_total(_p(spark, d).select("event_id", "side", "slot", "damage"), "damage", ["event_id", "side"], "total")
    return rounded(rows.withColumn("share", F.col("damage") / F.col("total")).drop("total"))


# ------------------------------------------------------------ windows


@query
def all_segment(spark: SparkSession, d: str) -> DataFrame:
    return P.with_all_segment(A.individual(_p(spark, d)), ["period", "slot", "entity"], ["games", "wins"])


@query
def window_definition(spark: SparkSession, d: str) -> DataFrame:
    return P.make_window(_m(spark, d))


@query
def window_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.windows(P.make_window(_m(spark, d)))


@query
def window_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = P.with_all_segment(A.individual(_p(spark, d)), ["period", "slot", "entity"], ["games", "wins"])
    return rounded(P.weighted_rate(P.cut_weights(rows, ["entity"], _window(spark, d)), ["segment", "slot", "entity"]))


@query
def window_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = P.cut_weights(A.trio_aggregate(_side_rows(spark, d)), list(A.TRIO), _window(spark, d))
    return rounded(P.weighted_stats(rows, ["segment", *A.TRIO], A.STAT_PAIRS), 4)


@query
def rework_cut(spark: SparkSession, d: str) -> DataFrame:
    """Head-to-heads where entity 3 was reworked in the newest period."""
    window = _window(spark, d)
    reworks = window.where("depth = 1").select(F.lit(3).cast("long").alias("entity"), F.col("period").alias("first_period"))
    return P.cut_weights(A.matchup_counts(_p(spark, d)), ["a", "b"], window, reworks).groupBy("a", "b").agg(F.sum("games").alias("games"), F.round(F.sum(F.col("weight") * F.col("games")), 4).alias("games_eff"))


# ------------------------------------------------------------ scores


def _scores(spark: SparkSession, d: str, what: str = "duo") -> DataFrame:
    names = ("individual", "duo", "duo_duration") + (("trio", "trio_duration") if what == "trio" else ())
    window = _window(spark, d)
    got = _aggregates(spark, d, names, window)
    duo = scores.score_duo(got["duo"], got["individual"], got["duo_duration"], window)
    if what == "duo":
        return duo
    duo = checkpointed(duo)
    return scores.score_trio(got["trio"], got["individual"], got["trio_duration"], duo, window)


def _matchup_scores(spark: SparkSession, d: str) -> DataFrame:
    window = _window(spark, d)
    got = _aggregates(spark, d, ("individual", "matchup"), window)
    return scores.score_matchup(got["matchup"], got["individual"], window)


SCORE = ["games", "games_eff", "rate", "ci_low", "ci_high", "synergy", "synergy_ci_low", "synergy_ci_high", "tier"]


@query
def duo_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scores(spark, d).select("label", "segment", *DUO_KEYS, *SCORE), 9)


@query
def duo_score_stats(spark: SparkSession, d: str) -> DataFrame:
    """The weighted means of every stat of the pair scores, the members' own too."""
    return rounded(_scores(spark, d).select("segment", *DUO_KEYS, *A.STAT_PAIRS, *A.DUO_MEMBER_PAIRS), 9)


@query
def trio_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scores(spark, d, "trio").select("label", "segment", *TRIO_KEYS, *SCORE, "prior"), 9)


@query
def scaling(spark: SparkSession, d: str) -> DataFrame:
    window = _window(spark, d)
    rows = P.with_all_segment(_aggregates(spark, d, ("duo_duration",), window)["duo_duration"], ["period", *DUO_KEYS, "bucket"], ["games", "wins"])
    got = P.scaling(P.cut_weights(rows, ["a", "b"], window), ["segment", *DUO_KEYS])
    return rounded(got, 5)


@query
def matchup_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_matchup_scores(spark, d))


def _versus(spark: SparkSession, d: str, counts: DataFrame, other: str, effect: str) -> DataFrame:
    trio = _t(spark, d).groupBy("period", "segment", *A.TRIO).agg(F.count("*").alias("games"), C.count_true("win").alias("wins"))
    return rounded(scores.score_versus(counts, trio, _window(spark, d), other, effect), 12)


@query
def counter_scores(spark: SparkSession, d: str) -> DataFrame:
    """Triples against each opponent, above or below their own rate."""
    return _versus(spark, d, A.combo_vs_entity(_t(spark, d), _p(spark, d)), "enemy", "delta")


@query
def ally_scores(spark: SparkSession, d: str) -> DataFrame:
    """Triples beside each ally, above or below their own rate."""
    return _versus(spark, d, A.combo_with_ally(_t(spark, d), _p(spark, d)), "ally", "uplift")


# ------------------------------------------------------------ reports


@query
def resilience(spark: SparkSession, d: str) -> DataFrame:
    return reports.resilience(_p(spark, d), _t(spark, d))


@query
def resilience_report(spark: SparkSession, d: str) -> DataFrame:
    got, _ = reports.resilience_report(reports.resilience(_p(spark, d), _t(spark, d)), 30, {"gap": (-0.2, None), "rate_behind": (0.3, 0.7)})
    return rounded(got)


@query
def slot_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.slot_distribution(A.individual(_p(spark, d)), 30)


@query
def primary_slot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.primary_slot(A.slot_distribution(A.individual(_p(spark, d)))))


@query
def flex_picks(spark: SparkSession, d: str) -> DataFrame:
    picks = _p(spark, d)
    return rounded(reports.flex(A.individual(picks), picks))


@query
def summary_report(spark: SparkSession, d: str) -> DataFrame:
    rows = P.cut_weights(_t(spark, d), list(A.TRIO), _window(spark, d))
    return rounded(reports.summarize(rows, ["segment", "jgl"]), 4)


@query
def pair_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.pair_rows(A.pair_vs_pair(_side_rows(spark, d), ("bot_sup",), "inner"))
    return rounded(reports.detail(rows, _window(spark, d), {"roles": "bot_sup", "a": 3}), 4)


@query
def tier_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 20 of reliable pairs, filtered and sorted, with the total."""
    rows = filters.segment_filter(rounded(_scores(spark, d)), "all").where("segment = 'all'")
    rows = filters.range_filter(filters.tier_at_least(rows, "moyen"), {"games": 60}, {"rate": 0.6}, ["games", "rate"])
    rows = checkpointed(rows.select(*DUO_KEYS, "games", "rate", "tier"))  # the page and the total read it
    rows, total = R.page(rows, R.order_columns(["rate", "games"], ["desc", "asc"], DUO_KEYS), 2, 20)
    return rows.join(F.broadcast(total))  # one row


@query
def top_partners(spark: SparkSession, d: str) -> DataFrame:
    rows = rounded(_scores(spark, d).where("segment = 'all'"))
    got = R.top_partners(rows, ["segment", "games", "synergy"], "JUNGLE", 3)
    return got.select("anchor", "slot", "partner", "games", "synergy", "rank")


@query
def top_matchups(spark: SparkSession, d: str) -> DataFrame:
    rows = rounded(_matchup_scores(spark, d).where("segment = 'all'"))
    by = R.top_matchups(rows, "by", 3, 10).withColumn("side", F.lit("by"))
    return by.unionByName(R.top_matchups(rows, "against", 3, 10).withColumn("side", F.lit("against"))).select("side", "slot", "a", "b", "delta", "rank")


@query
def pair_trios(spark: SparkSession, d: str) -> DataFrame:
    rows = rounded(_scores(spark, d, "trio").where("segment = 'all'"))
    return R.combos_with_pair(rows, {"jgl": 3, "mid": 5}, 8).select(*TRIO_KEYS, "games", "synergy")


@query
def member_rows(spark: SparkSession, d: str) -> DataFrame:
    """Triple aggregates that hold given members in two slots."""
    rows = _t(spark, d).groupBy("period", "segment", *A.TRIO).agg(F.count("*").alias("games"))
    return filters.member_filter(rows, jgl=3, mid=None, sup=7)


@query
def segment_volumes(spark: SparkSession, d: str) -> DataFrame:
    return A.segments(A.individual(_p(spark, d)))


@query
def stat_shares(spark: SparkSession, d: str) -> DataFrame:
    """Control of each entity as shares: of a fixed ceiling, blended with a theoretical
    one, of the best sibling in its slot, and of the slot's games."""
    rows = _p(spark, d).groupBy("slot", "entity").agg(F.avg(C.per_minute("cc_time_s", "duration_s")).alias("cc"), F.count("*").alias("games"))
    rows = A.with_group_total(rows, "games", ["slot"], "slot_games")
    theory = F.col("entity") * 100 / 11
    return rounded(rows.select("slot", "entity", C.empirical_pct("cc").alias("empirical"), C.blended_pct(C.empirical_pct("cc"), theory, "games").alias("blended"), C.bar_pct("cc", ["slot"]).alias("bar"), C.pct_of("games", "slot_games").alias("of_games")))


@query
def advice_tags(spark: SparkSession, d: str) -> DataFrame:
    """Advice for sides from their control and their lead at 15."""
    rows = _t(spark, d).select("event_id", "side", C.advice(F.col("jgl_cs_diff_15") / 500.0, C.per_minute("cc_time_s", "duration_s"), "gold_diff_15").alias("tags"))
    return rows.select("event_id", "side", F.array_join("tags", ",").alias("tags"))


@query
def inner_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The three pairs of one triple."""
    keys = [{"roles": "jgl_mid", "a": 3, "b": 5}, {"roles": "jgl_sup", "a": 3, "b": 7}, {"roles": "mid_sup", "a": 5, "b": 7}]
    return A.duo_aggregate_inner(A.pair_vs_pair(_side_rows(spark, d), A.INNER, "left")).transform(lambda x: filters.keys_in(x, keys)).select("period", "segment", *DUO_KEYS, "games", "wins")


# ------------------------------------------------------------ factors


def _label(window: DataFrame) -> str:
    return window.first().label


def _win_rows(spark: SparkSession, d: str) -> DataFrame:
    return factors.win_rows(_p(spark, d), _t(spark, d), _m(spark, d), _window(spark, d))


@query
def factor_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_win_rows(spark, d))


@query
def factor_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.moments(_win_rows(spark, d), factors.WIN_FEATURES), 3)


@query
def factor_gram(spark: SparkSession, d: str) -> DataFrame:
    rows = _win_rows(spark, d)
    got = M.gram(rows.withColumn("g", F.col("team_gold_diff_15") / 1000), ["g", "jgl_cs_diff_15"], "y", "weight")
    return rounded(got, 3)


@query
def auc_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.auc(_win_rows(spark, d), "y", "team_gold_diff_15"))


@query
def factor_r2(spark: SparkSession, d: str) -> DataFrame:
    rows = _win_rows(spark, d)
    return rounded(M.weighted_r2(rows, "y", F.lit(0.5) + F.col("team_gold_diff_15") / 100000, "weight"))


@query
def correlations(spark: SparkSession, d: str) -> DataFrame:
    rows = _win_rows(spark, d)
    one = rows.agg(M.pearson("team_gold_diff_15", "jgl_cs_diff_15").alias("pearson"))
    return rounded(one.join(F.broadcast(M.spearman(rows, "team_gold_diff_15", "jgl_cs_diff_15"))), 5)  # one row each


@query
def win_factors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factors.win_factors(spark, _win_rows(spark, d), _label(_window(spark, d))), 5)


@query
def win_factor_coefs(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of both populations, without the hold-out's rows."""
    return win_factors(spark, d).where("not startswith(feature, '_')")


@query
def gold_factors(spark: SparkSession, d: str) -> DataFrame:
    window, sides = _window(spark, d), _side_rows(spark, d)
    # tables of known size, which Spark broadcasts where they are small
    got = _aggregates(spark, d, ("individual", "matchup"), window)
    matchups = checkpointed(scores.score_matchup(got["matchup"], got["individual"], window))
    rows = factors.gold_rows_of_sides(_within(sides, window), window, got["individual"], matchups, checkpointed(_scores(spark, d, "trio")))
    return rounded(factors.gold_factors(spark, checkpointed(rows), _label(window)), 4)


@query
def vif(spark: SparkSession, d: str) -> DataFrame:
    got = M.vif(M.standardise(_win_rows(spark, d), factors.WIN_FEATURES), factors.WIN_FEATURES)
    return rounded(spark.createDataFrame(sorted(got.items()), "feature string, vif double"), 5)  # one row for each feature


# ------------------------------------------------------------ line-ups

MIN_GAMES = 20


def _duos(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(_scores(spark, d))


@query
def seed_rank(spark: SparkSession, d: str) -> DataFrame:
    duos = _scores(spark, d).where("segment = 'all'")
    got = compose.seeds(duos, compose.profile_table(duos, {"synergy": {"synergy": 1.0}, "lead": {"gold": 0.6, "rate": 0.4}}), MIN_GAMES)
    return rounded(got.select("archetype", "seed", F.round("total", 4).alias("total"), F.round("seed_score", 4).alias("seed_score")))


@query
def complete_round1(spark: SparkSession, d: str) -> DataFrame:
    duos = _duos(spark, d).where("segment = 'all'")
    profiles = compose.profile_table(duos, {"synergy": {"synergy": 1.0}})
    seeds = compose.seeds(duos, profiles, MIN_GAMES)
    grown = compose.complete_round(seeds, compose.partners(duos, MIN_GAMES), profiles, compose.pool_moments(compose.pool(duos, MIN_GAMES)))
    return compose.to_flat(grown.select(*compose.KEY, "placed", F.round("total", 4).alias("total"))).select("seed", "slot", "entity", "total")


@query
def compositions(spark: SparkSession, d: str) -> DataFrame:
    duos = _duos(spark, d)
    profiles = compose.profile_table(duos, {"synergy": {"synergy": 1.0}, "lead": {"gold": 0.6, "rate": 0.4}})
    return rounded(compose.to_flat(compose.complete(compose.seeds(duos, profiles, MIN_GAMES), duos, profiles, MIN_GAMES, rounds=3).drop("seed_score")), 6)


@query
def opponent_lineups(spark: SparkSession, d: str) -> DataFrame:
    """Line-ups against expected opponents, entity 1 in the middle and 2 on top: known
    head-to-heads add to a candidate's score, unknown ones never exclude it."""
    duos = _duos(spark, d)
    profiles = compose.profile_table(duos, {"counter": {"synergy": 0.6}})
    matchups = checkpointed(_matchup_scores(spark, d))
    enemy = matchups.select("segment").distinct().select("segment", F.explode(F.array(F.struct(F.lit("MIDDLE").alias("slot"), F.lit(1).cast("long").alias("enemy")), F.struct(F.lit("TOP").alias("slot"), F.lit(2).cast("long").alias("enemy")))).alias("x"))
    axis = checkpointed(compose.matchup_axis(matchups, enemy.select("segment", "x.*")))
    done = compose.complete(compose.seeds(duos, profiles, MIN_GAMES), duos, profiles, MIN_GAMES, rounds=3, axis=axis, axis_weight=0.4)
    return rounded(compose.to_flat(done.drop("seed_score")), 6)


@query
def pair_averages(spark: SparkSession, d: str) -> DataFrame:
    """Averages over the ten pairs of the line-ups that hold entity e in every slot."""
    duos = _duos(spark, d).where("segment = 'all'")
    entity = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("e")
    comps = duos.select(F.lit("all").alias("segment"), F.lit("synergy").alias("archetype")).distinct().select("*", entity)
    comps = comps.select("segment", "archetype", F.col("e").cast("string").alias("seed"), F.create_map(*[x for s in A.SLOTS for x in (F.lit(s), F.col("e"))]).alias("placed"))
    profiles = compose.profile_table(duos, {"synergy": {"synergy": 1.0}})
    got = compose.full_stats(comps, duos, profiles, compose.pool_moments(compose.pool(duos, MIN_GAMES)))
    return rounded(got.select("seed", "rate", "synergy", "gold_diff_15", "min_games_eff", "min_games"), 4)


@query
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Three variants of each profile after refinement, flat."""
    got = compose.propose(_duos(spark, d).where("segment = 'all'"), _matchup_scores(spark, d), MIN_GAMES, {"synergy": {"synergy": 1.0}, "lead": {"gold": 0.6, "rate": 0.4}})
    flat = compose.to_flat(got["suggestions"].select(*compose.KEY, "placed", "selection", "suggestion_rank", "score"))
    return rounded(flat, 4)


@query
def comp_matchups(spark: SparkSession, d: str) -> DataFrame:
    """Weak head-to-heads of the line-ups that hold entity e in every slot."""
    rows = checkpointed(_matchup_scores(spark, d).where("segment = 'all'")).withColumn("games_eff", F.col("games_eff") * 10)
    rows = rows.withColumn("delta", F.col("delta") * 10)
    comps = rows.select(F.lit("all").alias("segment"), F.lit("x").alias("archetype"), F.col("a").cast("string").alias("seed"), "a").distinct().select("segment", "archetype", "seed", F.create_map(*[x for s in A.SLOTS for x in (F.lit(s), F.col("a"))]).alias("placed"))
    return rounded(compose.rank_matchups(comps, rows, "weak"), 4)


# ------------------------------------------------------------ event log

KINDS = {"view": "VOID_GRUB", "signup": "RIFT_HERALD", "purchase": "TOWER", "error": "BARON", "click": "DRAGON"}


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The event table as an objective log: one log for each user and day."""
    e = table(spark, d, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    day = F.date_format("ts", "yyyyMMdd").cast("long")
    second = (F.unix_timestamp("ts") % 86400 / 20).cast("long")
    rows = e.select((F.col("user_id") * 100000000 + day).alias("event_id"), "event_id", second.alias("ts_s"), kind.alias("event_type"), F.when(F.col("event_id") % 2 == 0, 100).otherwise(200).alias("side")).toDF("event_id", "log_id", "ts_s", "event_type", "side")
    return E.with_seq(rows, "event_id", ["ts_s", "log_id"])


@query
def event_seq(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d)


@query
def first_taker(spark: SparkSession, d: str) -> DataFrame:
    return E.first_takers(_log(spark, d))


@query
def early_rollup(spark: SparkSession, d: str) -> DataFrame:
    return E.side_objectives(_log(spark, d))


@query
def gaps(spark: SparkSession, d: str) -> DataFrame:
    return R.gaps(table(spark, d, "events"), "ts", 600)


@query
def gaps_by_type(spark: SparkSession, d: str) -> DataFrame:
    return R.gaps(table(spark, d, "events"), "ts", 3600, 7, ["event_type"])


@query
def daily_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("ts").alias("created"), F.col("event_type").alias("segment"))
    return A.daily_pivot(e, sorted(KINDS))


@query
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("ts").alias("created"), F.col("event_type").alias("segment"), F.concat(F.lit("1."), (F.col("user_id") % 7).cast("string")).alias("period"))
    journal = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"))
    return A.ingest_status(e, journal)


# ------------------------------------------------------------ tables and sinks


@query
def dedup(spark: SparkSession, d: str) -> DataFrame:
    """Line keys that would be appended to a target holding every third order."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    target = lines.where("l_orderkey % 3 = 0")
    return sinks.new_rows(lines, target, ["l_orderkey", "l_linenumber"])


@query
def not_done(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    judged = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return joins.not_done(ids, done, judged, "key")


@query
def done_keys(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return joins.done_keys(o, c, key="key")


@query
def missing_facts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    return joins.missing(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])


@query
def keep_newest(spark: SparkSession, d: str) -> DataFrame:
    return P.keep_newest(_m(spark, d), 2).groupBy("period").agg(F.count("*").alias("n"))


@query
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders that an upsert would write: new keys, and totals that differ."""
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.round("o_totalprice")).alias("total"))
    old = new.where("key % 5 <> 0").withColumn("total", F.when(F.col("key") % 7 == 0, F.lit(1.0)).otherwise(F.col("total")))
    return sinks.changed_rows(new, old, ["key"])


@query
def merge_columns(spark: SparkSession, d: str) -> DataFrame:
    """Customer upsert that keeps the stored segment."""
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment", F.round("c_acctbal").alias("balance"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.round(F.col("c_acctbal") + 1).alias("balance"))
    return sinks.merge_columns(new, old, ["c_custkey"], ["c_mktsegment"])


@query
def backfill(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("value"))
    fix = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_suppkey").alias("value"))
    return sinks.backfill(o, fix, ["key"], ["value"], only_null=True)


@query
def retention(spark: SparkSession, d: str) -> DataFrame:
    """Rows that keeping the newest two periods would remove, by table."""
    _, counts = sinks.purge({"m": _m(spark, d), "p": _p(spark, d).drop("period")}, "period", 2, "event_id")
    return counts


@query
def contract(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), "l_linenumber", "l_returnflag")
    parent = table(spark, d, "orders").where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("event_id"))
    return sinks.validate(lines, ["event_id", "l_linenumber"], {"l_returnflag": ["A", "N"]}, parent)


@query
def work_list(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seen = e.groupBy("user_id").agg(F.max("ts").alias("checked"), F.min("ts").alias("discovered"), F.count("*").alias("n"))
    top = e.agg(F.max("ts").alias("now"))
    players = seen.join(F.broadcast(top)).select(F.col("user_id").alias("player"), (F.col("user_id") % 3).alias("segment"), (F.col("user_id") % 2 == 0).alias("active"), "checked", "discovered", "now")  # one row
    return R.work_list(players, 20, 2, 1).select("player", "segment", "position")


@query
def weight_requests(spark: SparkSession, d: str) -> DataFrame:
    """Which requested weight vectors are usable."""
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).alias("w_a"), F.when(F.col("p_size") % 5 != 0, 100.0 - F.col("p_size") + F.col("p_partkey") % 3 * 0.3 - F.when(F.col("p_partkey") % 7 == 0, 200).otherwise(0)).alias("w_b"))
    return rows.select("p_partkey", filters.weights_reason(["w_a", "w_b"]).alias("reason"))


# ------------------------------------------------------------ reference tables


@query
def markup_entries(spark: SparkSession, d: str) -> DataFrame:
    """Links of the page corpus under their running heading."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "(?i)(<(?:h[1-6]|p|li|a)[ >])", "\n$1").alias("text"))
    return ref.markup_entries(pages, "page_id", "text", r"<h[1-6][^>]*>([^<]*)", r'href="([^"]*)"', "nofollow|external|http")


@query
def overrides(spark: SparkSession, d: str) -> DataFrame:
    """Parts with edits: every 40th is excluded, every 25th gets a new size."""
    part = table(spark, d, "part").select("p_brand", "p_type", "p_partkey", "p_size")
    action = F.when(F.col("p_partkey") % 40 == 0, "exclude").when(F.col("p_partkey") % 25 == 0, "set").when(F.col("p_partkey") % 97 == 0, "add")
    edits = part.select("p_brand", "p_type", "p_partkey", (F.col("p_size") + 100).cast("int").alias("p_size"), action.alias("action")).where("action is not null")
    return ref.apply_overrides(part, edits, ["p_brand", "p_type"], ["p_size"], ["p_partkey"])


def _effects(spark: SparkSession, d: str) -> DataFrame:
    names = list(C.EFFECT_WEIGHTS)
    n = F.col("p_partkey")
    pick = lambda values, x: F.element_at(F.array(*map(F.lit, values)), (x % len(values) + 1).cast("int"))
    return table(spark, d, "part").select(
        F.col("p_brand").alias("entity"), F.col("p_type").alias("spell"), pick(names, n).alias("effect"), F.when(n % 9 != 0, F.col("p_size") / 10.0).alias("duration_s"),
        (n % 60 + 20).cast("double").alias("slow_pct"), pick(["single", "multi"], n).alias("area"), pick(["skillshot", "point_click", "skillshot"], n).alias("targeting"),
        pick(["base", "ultimate", "base"], n + 1).alias("availability"), (n % 4 == 0).cast("int").alias("reposition"), (n % 5 == 0).cast("int").alias("conditional"), (n % 30).cast("double").alias("cooldown_s"),
    )


@query
def spell_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ref.spell_scores(_effects(spark, d)), 4)


@query
def range_scores(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    spell = F.struct(F.col("p_partkey").cast("string").alias("id"), F.array(F.col("p_retailprice") * 5, F.col("p_size") * 10.0).alias("range"), F.when(F.col("p_size") % 3 != 0, F.array(F.col("p_size") * 1.0, F.lit(0.0))).alias("cooldown"))
    details = part.groupBy(F.col("p_brand").alias("entity")).agg(F.count("*").cast("double").alias("attack_range"), F.max("p_size").cast("double").alias("attack_speed"), F.array_sort(F.collect_list(spell)).alias("spells"))
    over = part.where("p_partkey % 6 = 0").select(F.col("p_brand").alias("entity"), F.col("p_partkey").cast("string").alias("spell"), F.when(F.col("p_partkey") % 12 == 0, F.lit(9000.0)).alias("reach"))
    return rounded(ref.range_scores(details, over), 4)


@query
def outlier_fence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_custkey").agg((F.sum("o_totalprice") / F.count("*")).alias("ratio"))
    return rounded(R.tukey_fence(rows, "ratio", 0.5), 4)


@query
def rank_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.round("s_acctbal", -2).alias("x"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("y"))
    return rounded(R.rank_gap(rows, "x", "y"))


@query
def reference_fill(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose blank balance comes from their nation's customers, else from a
    default by nation."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 3 != 0, F.round("s_acctbal")).alias("value"), F.lit(None).cast("string").alias("note"))
    other = table(spark, d, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.round(F.max("c_acctbal")).alias("value"))
    return ref.fill_defaults(ref.fill_from(s, other, ["s_nationkey"], ["value"]), "value", [(F.col("s_nationkey") < 20, 1.0), (F.lit(True), 2.0)])


@query
def reference_validation(spark: SparkSession, d: str) -> DataFrame:
    """How the effect scores of brands go with their mean retail price."""
    theory = ref.spell_scores(_effects(spark, d))
    real = A.entity_average(table(spark, d, "part").select(F.col("p_brand").alias("entity"), "p_retailprice"), "p_retailprice", 2)
    summary, _, _ = ref.validate_reference(theory, real)
    return rounded(summary, 4)


@query
def zscores(spark: SparkSession, d: str) -> DataFrame:
    rows = R.zscore(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_acctbal"], ["s_nationkey"])
    return rounded(rows.select("s_suppkey", "z_s_acctbal"))


@query
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Nations by name through aliases; the ones that resolve to nothing."""
    n = table(spark, d, "nation")
    alias = n.where("n_nationkey % 4 = 0").select(F.concat(F.lit("the "), "n_name").alias("alias"), F.col("n_name").alias("name"))
    asked = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("the "), "n_name")).otherwise(F.col("n_name")).alias("name"), F.col("n_nationkey").alias("asked"))
    found, lost = joins.resolve_names(asked, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("entity")), alias)
    return found.select("name", "asked", "entity").unionByName(lost.select("name", F.lit(None).cast("int").alias("asked"), F.lit(None).cast("int").alias("entity")))


def entry(spark: SparkSession, d: str) -> DataFrame:
    return basket_synergy(spark, d)


