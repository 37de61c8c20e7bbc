"""Filters and predicates."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TIERS


def segment_filter(df: DataFrame, segment: str | None) -> DataFrame:
    """Rows of one segment; None or 'all' keeps every row."""
    return df if segment in (None, "all") else df.where(F.col("segment") == segment)


def range_filter(df: DataFrame, mins: dict[str, float], maxs: dict[str, float], allowed: list[str]) -> DataFrame:
    """Conjunction of col >= min and col <= max over whitelisted columns."""
    if bad := sorted({*mins, *maxs} - set(allowed)):
        raise ValueError(f"not filterable: {bad}")
    tests = [F.col(c) >= v for c, v in mins.items()] + [F.col(c) <= v for c, v in maxs.items()]
    return df.where(reduce(and_, tests)) if tests else df


def tier_at_least(df: DataFrame, floor: str) -> DataFrame:
    return df.where(F.col("tier").isin(*TIERS[TIERS.index(floor) :]))


def member_filter(df: DataFrame, **slots: int | None) -> DataFrame:
    """Rows whose member columns equal the given entities; None doesn't filter."""
    for column, entity in slots.items():
        if entity is not None:
            df = df.where(F.col(column) == entity)
    return df


def keys_in(df: DataFrame, keys: list[dict[str, object]]) -> DataFrame:
    """Rows matching any of a few literal keys (a disjunction, so that it reaches
    the scan)."""
    tests = [reduce(and_, [F.col(c) == v for c, v in k.items()]) for k in keys]
    return df.where(reduce(or_, tests)) if tests else df.where(F.lit(False))


def drop_neutral(df: DataFrame, column: str, zone: float) -> DataFrame:
    return df.where(F.abs(F.col(column)) >= zone)


def behind_only(df: DataFrame, column: str = "team_gold_diff_15") -> DataFrame:
    return df.where(F.col(column) < 0)


def side_bounds(df: DataFrame, min_side: int, bounds: dict[str, tuple[float | None, float | None]]) -> tuple[DataFrame, DataFrame]:
    """Rows with enough games on both sides and derived rates within bounds, and
    the count of rows before the bounds (a one-row frame)."""
    ok = df.where((F.col("games_ahead") >= min_side) & (F.col("games_behind") >= min_side))
    ahead, behind = F.col("wins_ahead") / F.col("games_ahead"), F.col("wins_behind") / F.col("games_behind")
    ok = ok.withColumns({"rate_ahead": ahead, "rate_behind": behind, "gap": ahead - behind})
    out = ok
    for column, (lo, hi) in bounds.items():
        out = out if lo is None else out.where(F.col(column) >= lo)
        out = out if hi is None else out.where(F.col(column) <= hi)
    return out, ok.agg(F.count("*").alias("reliable_count"))


def weights_reason(columns: list[str]) -> Column:
    """Why a row's weight vector is unusable, or null: 'unset', 'negative' or
    'sum' (100 within 0.5)."""
    values = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    total = reduce(lambda a, b: a + b, values)
    unset = reduce(and_, [F.col(c).isNull() for c in columns])
    return F.when(unset, "unset").when(reduce(or_, [v < 0 for v in values]), "negative").when(F.abs(total - 100) > 0.5, "sum")


def check_weights(weights: dict[str, float | None]) -> dict[str, float] | None:
    """One weight vector in percent as fractions; None if none is set."""
    given = {k: float(v) for k, v in weights.items() if v is not None}
    if not given:
        return None
    if any(v < 0 for v in given.values()):
        raise ValueError("negative weight")
    if abs(sum(given.values()) - 100) > 0.5:
        raise ValueError("weights must sum to 100")
    return {k: v / 100 for k, v in given.items()}
