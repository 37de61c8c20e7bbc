"""Scores from hand-seeded aggregates with known answers."""

import pytest
from pyspark.sql import functions as F

from synergist.operators import aggregates as A
from synergist.operators import periods as P
from synergist.plans import scores


def seeded(spark, period="16.13"):
    ind = spark.createDataFrame([(period, "na1", "JUNGLE", 1, 100, 60), (period, "na1", "MIDDLE", 2, 100, 50), (period, "na1", "UTILITY", 3, 100, 40)], "period string, segment string, slot string, entity long, games long, wins long")

    def padded(rows, schema, pairs):
        df = spark.createDataFrame(rows, schema)
        return df.withColumns({c: F.lit(None).cast("double") for p in pairs.values() for c in p})

    duo = padded([(period, "na1", "jgl_mid", 1, 2, 40, 24), (period, "na1", "jgl_sup", 1, 3, 40, 20), (period, "na1", "mid_sup", 2, 3, 40, 18)], "period string, segment string, roles string, a long, b long, games long, wins long", {**A.STAT_PAIRS, **A.DUO_MEMBER_PAIRS})
    trio = padded([(period, "na1", 1, 2, 3, 10, 7)], "period string, segment string, jgl long, mid long, sup long, games long, wins long", {**A.STAT_PAIRS, **A.TRIO_MEMBER_PAIRS})
    duo_d = spark.createDataFrame([], "period string, segment string, roles string, a long, b long, bucket long, games long, wins long")
    trio_d = spark.createDataFrame([], "period string, segment string, jgl long, mid long, sup long, bucket long, games long, wins long")
    return ind, duo, trio, duo_d, trio_d


def test_known_scores(spark):
    ind, duo, trio, duo_d, trio_d = seeded(spark)
    window = P.window_of(spark, "16.13")
    duos = scores.score_duo(duo, ind, duo_d, window)
    got = {(r.segment, r.roles): r for r in duos.collect()}
    assert len(got) == 6
    r = got["na1", "jgl_mid"]
    assert (r.rate, r.synergy, r.tier) == (pytest.approx(0.6), pytest.approx(0.05), "faible")
    assert r.synergy_ci_low < 0.05 < r.synergy_ci_high
    assert r.scaling is None
    trios = scores.score_trio(trio, ind, trio_d, duos, window).collect()
    assert len(trios) == 2
    t = trios[0]
    prior = (40 * 0.05 / 240 + 0 + 0) / 3
    assert (t.games_eff, t.rate, t.synergy_raw) == (10, pytest.approx(0.7), pytest.approx(0.2))
    assert t.synergy == pytest.approx((10 * 0.2 + 200 * prior) / 210)


def test_rework_without_data(spark):
    ind, duo, trio, duo_d, trio_d = seeded(spark, "16.12")
    window = P.window_of(spark, "16.13+16.12")
    reworks = spark.createDataFrame([(1, "16.13")], "entity long, first_period string")
    duos = scores.score_duo(duo, ind, duo_d, window, reworks)
    assert {r.roles for r in duos.collect()} == {"mid_sup"}
    assert scores.score_trio(trio, ind, trio_d, duos, window, reworks).count() == 0


def test_range_dimension(spark):
    ind, duo, _, duo_d, _ = seeded(spark)
    dim = spark.createDataFrame([(1, 50.0), (9, 100.0)], "entity long, score double")
    got = scores.score_duo(duo, ind, duo_d, P.window_of(spark, "16.13"), range_dim=dim).where("segment = 'all' and roles = 'jgl_mid'").first()
    assert got.range_theoretical_pct == pytest.approx(25.0)
