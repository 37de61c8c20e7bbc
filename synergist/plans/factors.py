"""Factor models: what goes with winning, and with an early lead."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions.columns import is_test, per_minute, sigmoid
from ..operators import aggregates as A
from ..operators.joins import enrich, side_vs_side
from ..sources.scratch import checkpointed

WIN_FEATURES = ["team_gold_diff_15", "team_cc_per_min", "team_vision_per_min", "jgl_cs_diff_15"]
DRAFT_FEATURES = ["team_baseline_rate", "team_matchup_delta", "team_trio_synergy"]
PLAY_FEATURES = ["jgl_cs_diff_15", "first_blood_team", "herald_taken_pre15", "dragons_taken_pre15", "wards_pre15"]
CONTINUOUS = {*DRAFT_FEATURES, "jgl_cs_diff_15", "dragons_taken_pre15", "wards_pre15"}


def win_rows(roles: DataFrame, sides: DataFrame, events: DataFrame, window: DataFrame) -> DataFrame:
    """One row for each side of a complete event in the window: outcome y, the four
    features and the period's weight."""
    known = A.require(roles, ["gold_15"])
    agg = known.groupBy("event_id", "side").agg(F.sum("gold_15").alias("gold_15"), F.sum("cc_time_s").alias("cc"), F.sum("vision_score").alias("vision"), F.count("*").alias("n_slots"))
    both = side_vs_side(agg.where("n_slots = 5"), ["gold_15", "cc", "vision"])
    rows = A.with_event(both, events).join(F.broadcast(window.select("period", "weight")), "period")  # at most three rows
    rows = rows.join(A.require(sides, ["jgl_cs_diff_15"]).select("event_id", "side", "win", "jgl_cs_diff_15"), ["event_id", "side"])
    return rows.select(
        "event_id", "side", "period", F.col("weight").cast("double").alias("weight"), F.col("win").cast("double").alias("y"),
        (F.col("gold_15") - F.col("enemy_gold_15")).cast("double").alias("team_gold_diff_15"),
        per_minute("cc", "duration_s").alias("team_cc_per_min"),
        per_minute("vision", "duration_s").alias("team_vision_per_min"),
        F.col("jgl_cs_diff_15").cast("double").alias("jgl_cs_diff_15"),
    )


SCHEMA = "label string, population string, feature string, coef double, odds_ratio double, n long"


def win_factors(spark: SparkSession, rows: DataFrame, label: str, min_rows: int = 200) -> DataFrame:
    """Weighted logistic fit on all rows, and on rows behind at 15, with odds ratios
    and the AUC on a hold-out that neither its fit nor its moments saw.

    Both populations and their training parts are fitted together: one aggregate for
    the moments, one for the variance inflation, one for each round.
    """
    rows = checkpointed(rows)
    held = is_test("event_id")
    cases = {"all": F.lit(True), "behind_gold15": F.col("team_gold_diff_15") < 0}
    wheres = {**cases, **{f"{k}_train": c & ~held for k, c in cases.items()}, **{f"{k}_test": c & held for k, c in cases.items()}}
    m = M.moments_where(rows, WIN_FEATURES, wheres)
    one = F.lit(1.0)
    fitted = {k: c for k, c in cases.items() if m[k]["n"] >= min_rows}
    if not fitted:
        return spark.createDataFrame([], SCHEMA)
    shaky = M.grams_where(rows, {k: (c, M.scaled(WIN_FEATURES, m[k]), F.lit(0.0), one) for k, c in fitted.items()})
    todo = {k: {"where": c, **m[k], "ridge": M.VIF_RIDGE if max(M.vif_of(shaky[k], WIN_FEATURES).values()) > M.VIF_ALERT else M.RIDGE} for k, c in fitted.items()}
    tested = [k for k in fitted if m[f"{k}_train"]["n"] >= min_rows and m[f"{k}_test"]["n"]]
    todo |= {f"{k}_train": {"where": wheres[f"{k}_train"], **m[f"{k}_train"], "ridge": M.RIDGE} for k in tested}
    beta = M.fit_logistic_where(rows, WIN_FEATURES, "y", "weight", todo)
    out = []
    for k in fitted:
        out += [(label, k, f, b, math.exp(b), m[k]["n"]) for f, b in zip(["intercept", *WIN_FEATURES], beta[k], strict=True)]
        if k in tested:
            train = f"{k}_train"
            score = F.lit(beta[train][0])
            for z, b in zip(M.scaled(WIN_FEATURES, m[train]), beta[train][1:], strict=True):
                score = score + z * b
            auc = M.auc(rows.where(wheres[f"{k}_test"]).withColumn("p", sigmoid(score)), "y", "p").first()[0]
            if auc is not None:
                out.append((label, k, "_auc_test", auc, auc, m[f"{k}_test"]["n"]))
    return spark.createDataFrame(out, SCHEMA)  # at most twelve rows


def gold_rows(roles: DataFrame, sides: DataFrame, events: DataFrame, window: DataFrame, individual: DataFrame, matchups: DataFrame, trios: DataFrame) -> DataFrame:
    """One row for each side with team gold at 15, the draft's strength (mean
    baseline, matchups, trio synergy) and early play."""
    picks = A.with_event(A.require(roles, ["gold_15"]).select("event_id", "side", "slot", "entity", "gold_15"), events)
    picks = picks.join(F.broadcast(window.select("period")), "period", "left_semi")  # at most three rows
    faced = A.opponents(picks, ["entity", "gold_15", "period"])
    known = sides.where(PLAYED).drop("period", "segment", "duration_s").join(A.first_blood(roles), ["event_id", "side"])
    team = _drafts(faced, window, individual, matchups, []).join(known, ["event_id", "side"])
    return _with_synergy(team, trios)


PLAYED = "jgl_cs_diff_15 is not null and herald_taken_pre15 is not null"


def gold_rows_of_sides(rows: DataFrame, window: DataFrame, individual: DataFrame, matchups: DataFrame, trios: DataFrame) -> DataFrame:
    """The same from whole side rows: their role rows spread out, meet the small tables of
    rates, and fold again, so one grouping of the sides is all that is shuffled."""
    blood = F.exists(F.map_values("own"), lambda v: F.coalesce(v["first_blood"], F.lit(False)))
    own = [*A.TRIO, *(c for c in PLAY_FEATURES if c != "first_blood_team"), "first_blood_team"]
    rows = rows.where(PLAYED).withColumn("first_blood_team", blood)
    picks = A.require(A.seats(rows, ["event_id", "side", "period", *own], ("entity", "gold_15"), ("entity", "gold_15")), ["gold_15", "enemy_gold_15"])
    return _with_synergy(_drafts(picks, window, individual, matchups, own), trios)


def _drafts(faced: DataFrame, window: DataFrame, individual: DataFrame, matchups: DataFrame, own: list[str]) -> DataFrame:
    """Sides with all five slots: gold lead y, mean baseline and matchups, and their columns
    ``own``, from role rows beside the ones they face."""
    base = individual.groupBy("period", "slot", "entity").agg((F.sum("wins") / F.sum("games")).alias("baseline"))
    faced = faced.join(F.broadcast(window.select("period", "weight")), "period")  # at most three rows
    faced = enrich(faced, base, ["period", "slot", "entity"], ["baseline"])
    deltas = matchups.where(F.col("segment") == "all").select("slot", F.col("a").alias("entity"), F.col("b").alias("enemy_entity"), "delta")
    faced = enrich(faced, deltas, ["slot", "entity", "enemy_entity"], ["delta"])
    team = faced.groupBy("event_id", "side", "period", "weight").agg(
        (F.sum("gold_15") - F.sum("enemy_gold_15")).cast("double").alias("y"),
        F.avg("baseline").alias("team_baseline_rate"),
        F.coalesce(F.avg("delta"), F.lit(0.0)).alias("team_matchup_delta"),
        F.count("*").alias("n_slots"),
        *(F.first(c).alias(c) for c in own),
    )
    return team.where("n_slots = 5 and team_baseline_rate is not null")


def _with_synergy(rows: DataFrame, trios: DataFrame) -> DataFrame:
    synergy = trios.where(F.col("segment") == "all").select(*A.TRIO, F.col("synergy").alias("team_trio_synergy"))
    rows = enrich(rows, synergy, list(A.TRIO), ["team_trio_synergy"]).na.fill(0.0, ["team_trio_synergy"])
    return rows.select("event_id", "side", F.col("weight").cast("double").alias("weight"), "y", *(F.col(c).cast("double").alias(c) for c in [*DRAFT_FEATURES, *PLAY_FEATURES]))


def gold_factors(spark: SparkSession, rows: DataFrame, label: str, min_rows: int = 200) -> DataFrame:
    """Nested weighted least squares on team gold at 15: coefficients of the full
    model, and R2 of the draft block alone and of all."""
    schema = "label string, block string, feature string, coef double, n long"
    rows = rows.cache()
    try:
        n = rows.count()
        if n < min_rows:
            return spark.createDataFrame([], schema)
        features = [*DRAFT_FEATURES, *PLAY_FEATURES]
        z = M.standardise(rows, sorted(CONTINUOUS)).cache()
        shaky = M.vif(z, features)
        ridge = M.VIF_RIDGE if max(v for f, v in shaky.items() if f in CONTINUOUS) > M.VIF_ALERT else M.RIDGE
        r2 = {}
        for name, xs in (("_r2_draft_only", DRAFT_FEATURES), ("_r2_full", features)):
            beta = M.fit_ols(z, xs, "y", "weight", ridge)
            r2[name] = M.weighted_r2(z, "y", M.linear(xs, beta), "weight").first()[0]
        z.unpersist()
        block = lambda f: "draft" if f in DRAFT_FEATURES else "play" if f in PLAY_FEATURES else None
        out = [(label, block(f), f, b, n) for f, b in zip(["intercept", *features], beta, strict=True)] + [(label, None, k, v, n) for k, v in r2.items()]
        return spark.createDataFrame(out, schema)  # a dozen rows
    finally:
        rows.unpersist()
