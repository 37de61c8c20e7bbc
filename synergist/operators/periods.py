"""Periods and windows: recency weights, rework cutoffs, weighted rates and means,
the all-segments view, slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import STUDENT_T, period_key

#: Weights of the newest, second and third period (fixed values).
WEIGHTS = (1.0, 0.6, 0.35)
ALL = "all"


def make_window(periods: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(label, period, depth, weight) of the newest periods, newest first.

    ``periods`` is reduced to its distinct values by key before ranking, so
    the window sees a row for each period only. The label joins them with '+'.
    """
    newest = Window.orderBy(period_key("period").desc())
    top = periods.select("period").where(F.col("period").isNotNull()).distinct().withColumn("depth", F.row_number().over(newest)).where(F.col("depth") <= len(weights))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("depth"))
    every = Window.partitionBy(F.lit(0)).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    label = F.array_join(F.collect_list("period").over(every), "+")
    return top.select(label.alias("label"), "period", "depth", weight.alias("weight"))


def window_of(spark: SparkSession, label: str, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The same table from a label such as '16.13+16.12'."""
    rows = [(label, p, i + 1, w) for i, (p, w) in enumerate(zip(label.split("+"), weights, strict=False))]
    return spark.createDataFrame(rows, "label string, period string, depth int, weight double")


def keep_newest(df: DataFrame, n: int, period: str = "period") -> DataFrame:
    """Rows of the newest ``n`` periods, by numeric order."""
    keep = df.select(period).distinct().withColumn("_d", F.dense_rank().over(Window.orderBy(period_key(period).desc()))).where(F.col("_d") <= n).select(period)
    return df.join(F.broadcast(keep), period, "left_semi")  # n rows


def cut_weights(combos: DataFrame, members: list[str], window: DataFrame, reworks: DataFrame | None = None) -> DataFrame:
    """Weight of each row: its period's weight, but 0 for periods before the
    latest rework of any member. ``reworks`` has (entity, first_period).

    Rows outside the window go. The window has at most three rows and the
    reworks one for each entity: both are small dimension tables.
    """
    rows = combos.join(F.broadcast(window.select("period", "weight")), "period")
    if reworks is None:
        return rows
    cut = reworks.select("entity", period_key("first_period").alias("_cut"))
    for i, m in enumerate(members):
        rows = rows.join(cut.select(F.col("entity").alias(m), F.col("_cut").alias(f"_cut{i}")), m, "left")
    first = F.greatest(*(f"_cut{i}" for i in range(len(members)))) if len(members) > 1 else F.col("_cut0")
    weight = F.when(period_key("period") < first, F.lit(0.0)).otherwise(F.col("weight"))
    return rows.withColumn("weight", weight).drop(*(f"_cut{i}" for i in range(len(members))))


def with_all_segment(df: DataFrame, keys: list[str], sums: list[str], segment: str = "segment") -> DataFrame:
    """Add the rows of segment 'all': per-key sums over the segments. Sums of
    nothing but nulls stay null. Rows already labelled 'all' are replaced."""
    base = df.where(F.col(segment) != ALL).select(segment, *keys, *sums)
    rolled = base.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)).withColumn(segment, F.lit(ALL))
    return base.unionByName(rolled)


def weighted_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    """games, games_eff and rate of each key from (games, wins, weight) rows.

    Games count raw, over rows of positive weight; keys without effective games
    give no row.
    """
    rows = df.where("weight > 0")
    eff = F.sum(F.col("weight") * F.col("games"))
    got = rows.groupBy(*keys).agg(F.sum("games").alias("games"), eff.alias("games_eff"), (F.sum(F.col("weight") * F.col("wins")) / eff).alias("rate"))
    return got.where("games_eff > 0")


def weighted_mean_columns(pairs: dict[str, tuple[str, str]]) -> list[Column]:
    """Aggregates: for each stat sum(w * sum) / sum(w * n) over rows of positive
    weight with a sum and a positive n; null without any."""
    out = []
    for name, (total, n) in pairs.items():
        ok = (F.col("weight") > 0) & F.col(total).isNotNull() & (F.coalesce(F.col(n), F.lit(0)) > 0)
        den = F.sum(F.when(ok, F.col("weight") * F.col(n)))
        out.append(F.when(den > 0, F.sum(F.when(ok, F.col("weight") * F.col(total))) / den).alias(name))
    return out


def weighted_stats(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return df.groupBy(*keys).agg(*weighted_mean_columns(pairs))


def weighted_summary(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``weighted_rate`` and ``weighted_stats`` of each key in one grouping."""
    on = lambda c: F.sum(F.when(F.col("weight") > 0, c))
    eff = on(F.col("weight") * F.col("games"))
    rate = on(F.col("weight") * F.col("wins")) / eff
    got = df.groupBy(*keys).agg(on(F.col("games")).alias("games"), eff.alias("games_eff"), rate.alias("rate"), *weighted_mean_columns(pairs))
    return got.where("games_eff > 0")


def weighted_slope(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """slope, slope_lo, slope_hi of y on x by weighted least squares with a 95 %
    Student interval. Keys with fewer than 3 or more than 8 points, no weight or a
    constant x give nulls.

    Points are centred first (a window over the key's few points): the
    closed form from raw sums loses the residuals' digits.
    """
    by = Window.partitionBy(*keys)
    sw = F.sum(w).over(by)
    p = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(w).cast("double").alias("_w"), sw.alias("_sw"))
    p = p.withColumn("_dx", F.col("_x") - F.sum(F.col("_w") * F.col("_x")).over(by) / F.col("_sw")).withColumn("_dy", F.col("_y") - F.sum(F.col("_w") * F.col("_y")).over(by) / F.col("_sw"))
    num, den = F.sum(F.col("_w") * F.col("_dx") * F.col("_dy")).over(by), F.sum(F.col("_w") * F.col("_dx") * F.col("_dx")).over(by)
    p = p.withColumn("_den", den).withColumn("_slope", F.when(den > 0, num / den))
    off = F.col("_dy") - F.col("_slope") * F.col("_dx")
    g = p.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_sw").alias("_sw"), F.max("_den").alias("_den"), F.max("_slope").alias("_slope"), F.sum(F.col("_w") * off * off).alias("_rss"))
    t = F.element_at(F.create_map(*[z for k, v in STUDENT_T.items() for z in (F.lit(k), F.lit(v))]), (F.col("_n") - 2).cast("int"))
    ok = F.col("_n").between(3, 8) & (F.col("_sw") > 0) & (F.col("_den") > 0)
    margin = t * F.sqrt(F.greatest(F.lit(0.0), F.col("_rss")) / (F.col("_n") - 2) / F.col("_den"))
    return g.select(
        *keys,
        F.when(ok, F.col("_slope")).alias("slope"),
        F.when(ok, F.col("_slope") - margin).alias("slope_lo"),
        F.when(ok, F.col("_slope") + margin).alias("slope_hi"),
    )


def scaling(durations: DataFrame, keys: list[str], min_games: int = 3, min_buckets: int = 3) -> DataFrame:
    """Slope of the rate on the duration bucket, in points per five minutes.

    ``durations`` has the keys, bucket, games, wins, weight. A bucket needs
    ``min_games`` raw games, counted before weighting.
    """
    raw = durations.groupBy(*keys, "bucket").agg(
        F.sum("games").alias("_raw"),
        F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.col("games"))).alias("w"),
        F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.col("wins"))).alias("_wins"),
    )
    points = raw.where((F.col("_raw") >= min_games) & (F.col("w") > 0)).select(*keys, (F.col("bucket") / 5.0).alias("x"), (F.col("_wins") / F.col("w")).alias("y"), "w")
    got = weighted_slope(points, keys, "x", "y", "w")
    counts = points.groupBy(*keys).agg(F.count("*").alias("_k"))
    return got.join(counts, keys).where(F.col("_k") >= min_buckets).select(*keys, F.col("slope").alias("scaling"), F.col("slope_lo").alias("scaling_ci_low"), F.col("slope_hi").alias("scaling_ci_high"))
