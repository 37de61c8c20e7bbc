"""Sorting, paging, top-k and ranking windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import period_key
from ..sources.scratch import checkpointed
from .aggregates import PAIRS


def order_columns(keys: list[str], dirs: list[str], tail: list[str]) -> list[Column]:
    """Sort keys with their directions, nulls last both ways, then tail keys."""
    if len(keys) > 4 or len(keys) != len(dirs):
        raise ValueError("up to four sort keys, each with a direction")
    if bad := set(dirs) - {"asc", "desc"}:
        raise ValueError(f"unknown direction: {sorted(bad)}")
    return [F.col(k).desc_nulls_last() if d == "desc" else F.col(k).asc_nulls_last() for k, d in zip(keys, dirs, strict=True)] + [F.col(t).asc() for t in tail]


def order_by(df: DataFrame, keys: list[str], dirs: list[str], tail: list[str]) -> DataFrame:
    return df.orderBy(*order_columns(keys, dirs, tail))


def sort_nulls_last(df: DataFrame, key: str, desc: bool = True, tail: list[str] | None = None) -> DataFrame:
    return order_by(df, [key], ["desc" if desc else "asc"], tail or [])


def page(df: DataFrame, order: list[Column], number: int, per_page: int) -> tuple[DataFrame, DataFrame]:
    """(rows of page ``number`` from 1, one-row total). The page is a top-k of
    offset + limit rows; the total is a separate count."""
    if number < 1 or per_page < 1:
        raise ValueError("pages count from 1")
    rows = df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)
    return rows, df.agg(F.count("*").alias("total"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group (planned as a group limit before the shuffle)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def oriented(duos: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs seen from both members: anchor_slot, anchor, slot, partner."""
    slot = lambda i: F.element_at(F.create_map(*[x for p, s in PAIRS.items() for x in (F.lit(p), F.lit(s[i]))]), F.col("roles"))
    a, b = slot(0), slot(1)
    one = duos.select(*columns, "roles", a.alias("anchor_slot"), F.col("a").alias("anchor"), b.alias("slot"), F.col("b").alias("partner"))
    two = duos.select(*columns, "roles", b.alias("anchor_slot"), F.col("b").alias("anchor"), a.alias("slot"), F.col("a").alias("partner"))
    return one.unionByName(two)


def top_partners(duos: DataFrame, columns: list[str], slot: str, k: int, entity: int | None = None, by: str = "synergy") -> DataFrame:
    """Best ``k`` partners of an entity in a slot (of every entity if None)."""
    rows = oriented(duos, columns).where(F.col("anchor_slot") == slot)
    if entity is not None:
        rows = rows.where(F.col("anchor") == entity)
    return top_k(rows, ["segment", "anchor"], [F.col(by).desc_nulls_last(), F.col("slot"), F.col("partner")], k)


def top_matchups(matchups: DataFrame, side: str, k: int, min_games_eff: float = 0.0) -> DataFrame:
    """Best head-to-heads of each entity: side 'by' ranks its own opponents by
    delta, side 'against' ranks those that do best against it."""
    own = "a" if side == "by" else "b"
    rows = matchups.where(F.col("games_eff") >= min_games_eff)
    other = "b" if side == "by" else "a"
    return top_k(rows, ["segment", "slot", own], [F.col("delta").desc(), F.col(other)], k)


def combos_with_pair(trios: DataFrame, pair: dict[str, int], k: int, by: str = "synergy") -> DataFrame:
    """Best triples that hold both given members (columns to entities)."""
    for column, entity in pair.items():
        trios = trios.where(F.col(column) == entity)
    return trios.orderBy(F.col(by).desc_nulls_last(), "segment", "jgl", "mid", "sup").limit(k)


def gaps(df: DataFrame, ts: str, threshold_s: int, lookback_days: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Silences longer than ``threshold_s`` between consecutive times.

    Without a partition, times are bucketed by hour: gaps inside an hour come from
    a window over it, gaps between hours from the hours' first and last times, so
    no single task sees every row.
    """
    by = by or []
    rows = df.select(*by, F.col(ts).alias("_t"))
    if lookback_days is not None:
        newest = rows.agg(F.max("_t").alias("_top"))
        rows = rows.join(F.broadcast(newest)).where(F.col("_t") > F.col("_top") - F.make_interval(days=F.lit(lookback_days))).drop("_top")  # one row
    rows = rows.withColumn("_h", F.date_trunc("hour", "_t"))
    inside = rows.select(*by, F.lag("_t").over(Window.partitionBy(*by, "_h").orderBy("_t")).alias("gap_start"), F.col("_t").alias("gap_end"))
    hours = rows.groupBy(*by, "_h").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    day = F.date_trunc("day", "_h")
    # hours are few (8 766 a year): one ordered pass over them
    between = hours.select(*by, F.lag("hi").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_h")).alias("gap_start"), F.col("lo").alias("gap_end"), day.alias("_d")).drop("_d")
    seconds = F.unix_timestamp("gap_end") - F.unix_timestamp("gap_start")
    return inside.unionByName(between).where(seconds > threshold_s).withColumn("gap_s", seconds)


def rows_below(values: DataFrame, column: str, n: str, name: str) -> DataFrame:
    """``values``, which has each value of ``column`` once, with the sum of ``n`` over all
    smaller ones (null is smallest).

    Values are dealt in ranges and summed up within each; the sums before a range come
    from one row for each range. No task sees all values.
    """
    ranged = checkpointed(values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ranged.groupBy("_part").agg(F.sum(n).alias("_sum")).select("_part", before(Window.orderBy("_part")).alias("_base"))
    inside = ranged.withColumn("_sum", F.col(n)).withColumn("_in", before(Window.partitionBy("_part").orderBy(column)))
    return inside.join(bases, "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_part", "_sum", "_base", "_in")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with exact interpolated quantiles q0, q1, ... of a column (nulls don't
    count; null without any value).

    Each value is counted once, values are dealt in ranges, and the rows before a value
    tell whether a wanted rank falls on it: no task sees all values, however often one
    repeats.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    placed = checkpointed(rows_below(counts, "_v", "_n", "_below"))
    total = placed.agg(F.sum("_n").alias("_all"))
    rows = placed.join(F.broadcast(total))  # one row
    out = []
    for i, share in enumerate(shares):
        at = (F.col("_all") - 1) * F.lit(float(share))
        on = lambda rank: F.max(F.when((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n")), F.col("_v")))
        low, high = on(F.floor(at)), on(F.ceil(at))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(f"q{i}"))
    return rows.agg(*out)


def tukey_fence(df: DataFrame, ratio: str, k: float = 3.0) -> DataFrame:
    """Rows above Q3 + k (Q3 - Q1) of the ratio (exact, interpolated quartiles)."""
    q = quantiles(df, ratio, [0.25, 0.75]).select((F.col("q1") + (F.col("q1") - F.col("q0")) * k).alias("fence"))
    return df.join(F.broadcast(q)).where(F.col(ratio) > F.col("fence"))  # one row


def avg_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Average rank with ties, from the counts of the distinct values in ranges."""
    values = rows_below(df.groupBy(column).agg(F.count("*").alias("_n")), column, "_n", "_below")
    ranks = values.select(column, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, df[column].eqNullSafe(ranks[column])).drop(ranks[column])


def primary_slot(distribution: DataFrame) -> DataFrame:
    """(entity, primary_slot, games, share) by most games; ties by slot name."""
    total = F.sum("games").over(Window.partitionBy("entity"))
    rows = distribution.withColumn("share", F.col("games") / total)
    return top_k(rows, ["entity"], [F.col("games").desc(), F.col("slot")], 1).select("entity", F.col("slot").alias("primary_slot"), "games", "share")


def zscore(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Add z_<col>: population z-score within the group over known values. Fewer
    than two values, or no spread, gives mean and deviation (0, 1) or deviation 1."""
    moments = [m for c in columns for m in (F.count(c).alias(f"_n_{c}"), F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    rows = df.join(df.groupBy(*by).agg(*moments), by)
    for c in columns:
        few = F.col(f"_n_{c}") < 2
        mean = F.when(few, F.lit(0.0)).otherwise(F.col(f"_m_{c}"))
        dev = F.when(few | (F.col(f"_s_{c}") == 0), F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        rows = rows.withColumn(f"z_{c}", (F.col(c) - mean) / dev)
    return rows.drop(*(f"_{x}_{c}" for c in columns for x in "nms"))


def rank_gap(df: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """Rows with the largest differences of normalised ranks: ``k`` at each end."""
    ranked = avg_rank(avg_rank(df, a, "_ra"), b, "_rb")
    n = df.agg(F.count("*").alias("_n"))
    gap = (F.col("_ra") - F.col("_rb")) / F.col("_n")
    rows = ranked.join(F.broadcast(n)).withColumn("gap", gap).drop("_ra", "_rb", "_n")  # one row
    top = rows.orderBy(F.col("gap").desc(), "entity").limit(k).withColumn("end", F.lit("over"))
    return top.unionByName(rows.orderBy("gap", "entity").limit(k).withColumn("end", F.lit("under")))


def work_list(players: DataFrame, per_segment: int, active_hours: int = 12, idle_days: int = 14) -> DataFrame:
    """Stalest-first list for each segment: players whose recheck is due.

    Active players come due ``active_hours`` after their last check, idle ones
    after ``idle_days``; never checked ones are due at once. Needs (player, segment,
    active, checked, discovered, now).
    """
    wait = F.when(F.col("active"), F.make_interval(hours=F.lit(active_hours))).otherwise(F.make_interval(days=F.lit(idle_days)))
    due = F.coalesce(F.col("checked") + wait, F.timestamp_seconds(F.lit(0)))
    rows = players.withColumn("next_check", due).where(F.col("next_check") <= F.col("now"))
    return top_k(rows, ["segment"], [F.col("next_check"), F.col("discovered"), F.col("player")], per_segment, "position")
