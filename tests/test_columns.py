import pytest
from pyspark.sql import functions as F

from synergist.functions import columns as C
from synergist.functions import models as M
from synergist.operators import periods as P


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_wilson_known_value(spark):
    lo, hi = one(spark, C.wilson(F.lit(0.6), F.lit(100.0)))
    assert (lo, hi) == (pytest.approx(0.502, abs=2e-3), pytest.approx(0.691, abs=2e-3))
    assert tuple(one(spark, C.wilson(F.lit(0.6), F.lit(0.0)))) == (0.0, 1.0)


def test_shrink_tier_synergy(spark):
    assert one(spark, C.shrink(F.lit(1.0), F.lit(200.0), F.lit(0.0))) == 0.5
    with pytest.raises(ValueError):
        C.shrink(F.lit(1.0), F.lit(1.0), F.lit(0.0), -1)
    assert [one(spark, C.tier(F.lit(n))) for n in (49.0, 50.0, 399.0, 400.0)] == ["faible", "moyen", "moyen", "eleve"]
    assert one(spark, C.synergy(F.lit(0.6), [F.lit(0.6), F.lit(0.5)])) == pytest.approx(0.05)


def test_newcombe_contains_difference(spark):
    lo, hi = one(spark, C.newcombe(*map(F.lit, (0.6, 0.5, 0.7, 0.5, 0.45, 0.55))))
    assert lo < 0.1 < hi


def test_period_order_is_numeric(spark):
    rows = spark.createDataFrame([("16.9",), ("16.10",), ("16.10",)], "period string")
    got = P.make_window(rows).orderBy("depth").collect()
    assert [(r.label, r.period, r.weight) for r in got] == [("16.10+16.9", "16.10", 1.0), ("16.10+16.9", "16.9", 0.6)]


def test_slopes(spark):
    rows = [("line", x, 1.0 + 2 * x, 10.0) for x in range(3)]
    rows += [("few", 0.0, 1.0, 1.0), ("few", 1.0, 1.0, 1.0)]
    rows += [("flat_x", 1.0, y, 1.0) for y in (1.0, 2.0, 3.0)]
    rows += [("many", float(x), 1.0, 1.0) for x in range(9)]
    rows += [("outlier", 0.0, 0.0, 100.0), ("outlier", 1.0, 1.0, 100.0), ("outlier", 2.0, 50.0, 0.001)]
    df = spark.createDataFrame([(k, float(x), y, w) for k, x, y, w in rows], "k string, x double, y double, w double")
    got = {r.k: r for r in P.weighted_slope(df, ["k"], "x", "y", "w").collect()}
    assert (got["line"].slope, got["line"].slope_lo, got["line"].slope_hi) == (pytest.approx(2), pytest.approx(2), pytest.approx(2))
    assert got["few"].slope is got["flat_x"].slope is got["many"].slope is None
    assert got["outlier"].slope == pytest.approx(1.0, abs=0.01)


def test_all_segment_keeps_null_sums(spark):
    df = spark.createDataFrame([("a", "p", 1, None), ("b", "p", 2, None)], "segment string, period string, games long, s double")
    got = P.with_all_segment(df, ["period"], ["games", "s"]).where("segment = 'all'").first()
    assert (got.games, got.s) == (3, None)


def test_rework_cut(spark):
    window = P.window_of(spark, "16.13+16.12")
    combos = spark.createDataFrame([("16.12", 1, 2), ("16.13", 1, 2), ("16.12", 3, 2)], "period string, a long, b long")
    reworks = spark.createDataFrame([(1, "16.13")], "entity long, first_period string")
    got = {(r.period, r.a): r.weight for r in P.cut_weights(combos, ["a", "b"], window, reworks).collect()}
    assert got == {("16.12", 1): 0.0, ("16.13", 1): 1.0, ("16.12", 3): 0.6}


def test_advice_and_contribution(spark):
    assert one(spark, C.advice(F.lit(0.05), F.lit(None).cast("double"), F.lit(-400.0))) == ["late", "patience"]
    df = spark.createDataFrame([("stun", 2.0, None, "multi", "skillshot", "base", 0, 0, 6.0), ("slow", 1.0, None, "single", "skillshot", "base", 0, 0, None)], "effect string, duration_s double, slow_pct double, area string, targeting string, availability string, reposition int, conditional int, cooldown_s double")
    assert [r[0] for r in df.select(C.contribution()).collect()] == [pytest.approx(0.9 * 2 * 1.5 * 1.5), 0.0]


def test_auc_and_ols(spark):
    df = spark.createDataFrame([(1.0, 0.9), (1.0, 0.5), (0.0, 0.5), (0.0, 0.1)], "y double, s double")
    assert M.auc(df, "y", "s").first()[0] == pytest.approx(0.875)
    assert M.auc(df.where("y = 1"), "y", "s").first()[0] is None
    line = spark.createDataFrame([(float(x), 3.0 + 2 * x, 1.0) for x in range(5)], "x double, y double, w double")
    assert M.fit_ols(line, ["x"], "y", "w") == [pytest.approx(3, abs=1e-4), pytest.approx(2, abs=1e-4)]
