"""Statistical column functions. Everything here takes and returns Columns, so
it stays inside code generation; nothing is a Python UDF."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Z_95 = 1.959963984540054
PRIOR_K = 200.0
TIERS = ("faible", "moyen", "eleve")
TIER_THRESHOLDS = (50.0, 400.0)
#: Two-sided 95 % Student t by degrees of freedom (fixed values).
STUDENT_T = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447}


def _c(x: Column | str | float | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def unit(x: Column) -> Column:
    """Clamp to [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def wilson(rate, n, z: float = Z_95) -> Column:
    """Wilson interval of a proportion as struct(lo, hi); [0, 1] if n <= 0."""
    p, n = _c(rate), _c(n)
    spread = z * z / n
    center = (p + spread / 2) / (spread + 1)
    margin = F.sqrt(p * (1 - p) / n + spread / (n * 4)) * z / (spread + 1)
    empty = n <= 0
    return interval(
        F.when(empty, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), center - margin)),
        F.when(empty, F.lit(1.0)).otherwise(F.least(F.lit(1.0), center + margin)),
    )


def normal_ci(rate, se, z: float = Z_95) -> Column:
    """Normal interval clamped to [0, 1]."""
    p, margin = _c(rate), _c(se) * z
    return interval(F.greatest(F.lit(0.0), p - margin), F.least(F.lit(1.0), p + margin))


def newcombe(p1, l1, u1, p2, l2, u2) -> Column:
    """Newcombe's interval of the difference p1 - p2 from the two intervals."""
    p1, l1, u1, p2, l2, u2 = map(_c, (p1, l1, u1, p2, l2, u2))
    hyp = lambda a, b: F.sqrt(a * a + b * b)
    return interval(p1 - p2 - hyp(p1 - l1, u2 - p2), p1 - p2 + hyp(u1 - p1, p2 - l2))


def mean_of(xs: Iterable[Column]) -> Column:
    xs = [_c(x) for x in xs]
    return reduce(add, xs) / len(xs)


def synergy(rate, members: Iterable[Column]) -> Column:
    """A combination's rate above the mean of its members' own rates."""
    return _c(rate) - mean_of(members)


def shrink(raw, n, prior, k: float = PRIOR_K) -> Column:
    """(n raw + k prior) / (n + k)."""
    if k < 0:
        raise ValueError(f"negative prior weight: {k}")
    raw, n, prior = _c(raw), _c(n), _c(prior)
    return (n * raw + prior * k) / (n + k)


def tier(n_eff, low: float = TIER_THRESHOLDS[0], high: float = TIER_THRESHOLDS[1]) -> Column:
    n = F.round(_c(n_eff), 9)  # sums of weights must not fall short of a threshold by noise
    return F.when(n < low, TIERS[0]).when(n < high, TIERS[1]).otherwise(TIERS[2])


def synergy_ci(rate, n_eff, members: list[tuple[Column, Column]]) -> Column:
    """Interval of the raw synergy: Wilson on the combination, normal on the
    baseline whose variance is sum p(1-p)/n over the members, over m squared."""
    rate = _c(rate)
    m = len(members)
    base = mean_of(p for p, _ in members)
    var = reduce(add, [_c(p) * (1 - _c(p)) / _c(n) for p, n in members]) / float(m * m)
    own, other = wilson(rate, n_eff), normal_ci(base, F.sqrt(var))
    return newcombe(rate, own["lo"], own["hi"], base, other["lo"], other["hi"])


def period_key(period) -> Column:
    """'16.9' as struct(major, minor) of ints: 16.9 sorts before 16.10."""
    parts = F.split(_c(period), r"\.")
    return F.struct(F.get(parts, F.lit(0)).cast("int").alias("major"), F.get(parts, F.lit(1)).cast("int").alias("minor"))


def theoretical_pct(raw, members: int, best) -> Column:
    """100 raw / (members * best entity); 0 if the ceiling is 0, null without one."""
    ceiling = _c(best) * members
    return F.when(ceiling > 0, _c(raw) * 100 / ceiling).when(ceiling.isNotNull(), F.lit(0.0))


def empirical_pct(x, ceiling: float = 6.0) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.least(x * 100 / ceiling, F.lit(100.0)))


def blended_pct(empirical, theoretical, n_eff, k: float = PRIOR_K) -> Column:
    """Empirical share shrunk to the theoretical one; the latter alone if absent."""
    return shrink(F.coalesce(_c(empirical), _c(theoretical)), n_eff, theoretical, k)


def sigmoid(eta) -> Column:
    eta = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), _c(eta)))
    return 1 / (1 + F.exp(-eta))


def is_test(key, modulus: int = 5) -> Column:
    """Deterministic hold-out: crc32 of the key as text modulo ``modulus`` is 0."""
    return F.crc32(_c(key).cast("string").cast("binary")) % modulus == 0


def bar_pct(value, by: list[str] | None = None) -> Column:
    """Share of the largest absolute value among the siblings, capped at 100."""
    v = F.abs(_c(value))
    top = F.max(v).over(Window.partitionBy(*(by or [F.lit(0)])))
    return F.when(top > 0, F.least(F.lit(100.0), v * 100 / top)).otherwise(F.lit(0.0))


def pct_of(n, total) -> Column:
    return F.when(_c(total) > 0, _c(n) * 100 / _c(total)).otherwise(F.lit(0.0))


#: Thresholds of the advice tags (fixed values).
ADVICE_SCALING, ADVICE_CONTROL, ADVICE_GOLD = 0.03, 2.5, 350.0


def advice(scaling, control, gold) -> Column:
    """At most one tag for each theme, in theme order; null stats give none. Scaling and
    gold must pass their thresholds, control must reach its own."""
    s, c, g = _c(scaling), _c(control), _c(gold)
    return F.array_compact(
        F.array(
            F.when(s > ADVICE_SCALING, "late").when(s < -ADVICE_SCALING, "early"),
            F.when(c >= ADVICE_CONTROL, "control"),
            F.when(g > ADVICE_GOLD, "lead").when(g < -ADVICE_GOLD, "patience"),
        )
    )


def deviation(value, base) -> Column:
    """Signed difference, null if either is missing."""
    return _c(value) - _c(base)


def per_minute(x, seconds) -> Column:
    """x / (seconds / 60): the same order of operations as the aggregates use."""
    return _c(x) / (_c(seconds) / 60.0)


def duration_bucket(seconds) -> Column:
    """Five-minute bucket by integer division, 40 and above together."""
    return F.least(F.lit(40).cast("long"), F.floor(_c(seconds).cast("long") / 300).cast("long") * 5)


def any_true(x) -> Column:
    """Aggregate: true if any is true; all null counts as false."""
    return F.coalesce(F.bool_or(_c(x)), F.lit(False))


def count_true(x) -> Column:
    return F.count_if(_c(x))


#: Weights by effect and coefficients of a contribution (fixed values).
EFFECT_WEIGHTS = {
    "airborne": 1.0,
    "suppression": 1.0,
    "stun": 0.9,
    "charm": 0.9,
    "fear": 0.9,
    "taunt": 0.9,
    "sleep": 0.9,
    "root": 0.7,
    "silence": 0.5,
    "ground": 0.5,
    "blind": 0.5,
    "polymorph": 0.5,
    "slow": 0.3,
}
COEF_ZONE = 1.5
COEF_POINT_CLICK = 1.2
COEF_ULTIMATE = 0.5
COEF_REPOSITION = 1.15
COEF_CONDITIONAL = 0.7
COOLDOWN_REFERENCE_S = 12.0
FREQUENCY_CAP = 1.5


def contribution(effect="effect", duration="duration_s", slow_pct="slow_pct", area="area", targeting="targeting", availability="availability", reposition="reposition", conditional="conditional", cooldown="cooldown_s") -> Column:
    """Contribution of one effect row: weight times duration times its
    coefficients and a capped frequency bonus. No duration, or a slow without a
    percentage, contributes 0."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in EFFECT_WEIGHTS.items() for x in kv]), _c(effect))
    slow = _c(effect) == "slow"
    factor = lambda cond, k: F.when(cond, F.lit(k)).otherwise(F.lit(1.0))
    often = F.when(
        (_c(cooldown) > 0) & (_c(availability) == "base"),
        F.least(F.lit(FREQUENCY_CAP), F.greatest(F.lit(1.0), F.lit(COOLDOWN_REFERENCE_S) / _c(cooldown))),
    ).otherwise(F.lit(1.0))
    value = (
        weight
        * _c(duration)
        * F.when(slow, _c(slow_pct) / 100).otherwise(F.lit(1.0))
        * factor(_c(area) == "multi", COEF_ZONE)
        * factor(_c(targeting) == "point_click", COEF_POINT_CLICK)
        * factor(_c(availability) == "ultimate", COEF_ULTIMATE)
        * factor(_c(reposition) == 1, COEF_REPOSITION)
        * factor(_c(conditional) == 1, COEF_CONDITIONAL)
        * often
    )
    return F.coalesce(value, F.lit(0.0))
