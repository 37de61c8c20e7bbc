"""Reference-table jobs: markup extraction, overrides, defaults, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import contribution
from ..functions.models import pearson, spearman
from .ranking import rank_gap


def markup_entries(pages: DataFrame, key: str, text: str, header: str, entry: str, flag: str) -> DataFrame:
    """(key, category, entry, flagged) from marked-up pages, read line by line.

    A line matching ``header`` sets the running category of the lines below it, each
    match of ``entry`` in a line is an entry, and ``flag`` marks a line's entries.
    Repeats fold into one row, flagged if any was. Patterns have one group.
    """
    lines = pages.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    title = F.regexp_extract("line", header, 1)
    lines = lines.withColumn("_h", F.when(title != "", title))
    below = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("category", F.last("_h", ignorenulls=True).over(below))
    rows = lines.select(key, "category", F.explode(F.regexp_extract_all("line", F.lit(entry), F.lit(1))).alias("entry"), F.col("line").rlike(flag).alias("_f"))
    return rows.groupBy(key, "category", "entry").agg(F.bool_or("_f").alias("flagged"))


def template_field(text: Column, name: str) -> Column:
    """Value of ``|name = value`` in a template, trimmed; null if absent."""
    got = F.trim(F.regexp_extract(text, rf"(?m)^[ \t]*\|[ \t]*{name}[ \t]*=[ \t]*(.*?)[ \t]*$", 1))
    return F.when(got != "", got)


def min_number(text: Column) -> Column:
    """Smallest number written in an expression; null without any."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.array_min(F.transform(numbers, lambda x: x.cast("double")))


def apply_overrides(rows: DataFrame, overrides: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """'set' replaces the given values of a row, 'exclude' drops it, 'add' appends.
    The n-th override of a key goes to the key's n-th row."""
    nth = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    edits = nth(overrides.where(F.col("action").isin("set", "exclude")), order).select(*keys, "_n", F.col("action").alias("_action"), *(F.col(v).alias(f"_o_{v}") for v in values))
    joined = nth(rows, order).join(edits, [*keys, "_n"], "left").where(~F.coalesce(F.col("_action") == "exclude", F.lit(False)))
    value = lambda v: F.when(F.col("_action") == "set", F.coalesce(f"_o_{v}", v)).otherwise(F.col(v))
    kept = joined.select(*(value(c).alias(c) if c in values else F.col(c) for c in rows.columns))
    added = overrides.where(F.col("action") == "add")
    return kept.unionByName(added.select(*[c for c in rows.columns if c in added.columns]), allowMissingColumns=True)


def fill_defaults(rows: DataFrame, column: str, rules: list[tuple[Column, float]]) -> DataFrame:
    """Unknown values by the first rule that applies; which rows were filled is
    noted in ``defaulted``."""
    default = F.lit(None).cast("double")
    for when, v in reversed(rules):
        default = F.when(when, F.lit(float(v))).otherwise(default)
    return rows.withColumn("defaulted", F.col(column).isNull() & default.isNotNull()).withColumn(column, F.coalesce(F.col(column), default))


def fill_from(primary: DataFrame, fallback: DataFrame, keys: list[str], columns: list[str], note: str = "note") -> DataFrame:
    """Blank columns from a second source, the first always winning; rows that took
    something are annotated. Of fallback rows that repeat a key, the largest counts."""
    other = fallback.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_f")).select(*keys, *(F.col(f"_f.{c}").alias(f"_f_{c}") for c in columns))
    rows = primary.join(other, keys, "left")
    took = [F.when(F.col(c).isNull() & F.col(f"_f_{c}").isNotNull(), F.lit(c)) for c in columns]
    noted = F.concat_ws(";", F.col(note), *[F.concat(F.lit("filled:"), t) for t in took])
    rows = rows.withColumn("_note", noted)
    return rows.select(*(F.coalesce(c, f"_f_{c}").alias(c) if c in columns else F.when(F.col("_note") != "", F.col("_note")).alias(note) if c == note else F.col(c) for c in primary.columns))


def spell_scores(ref: DataFrame) -> DataFrame:
    """Score of each entity: over its spells the strongest hard effect plus all
    slows."""
    rows = ref.withColumn("_v", contribution())
    slow = F.col("effect") == "slow"
    spells = rows.groupBy("entity", "spell").agg((F.coalesce(F.max(F.when(~slow, F.col("_v"))), F.lit(0.0)) + F.coalesce(F.sum(F.when(slow, F.col("_v"))), F.lit(0.0))).alias("_s"))
    return spells.groupBy("entity").agg(F.sum("_s").alias("score"))


RANGE_CAP, MIN_COOLDOWN, ACTIVE_SPELLS = 8000.0, 4.0, 4


def range_scores(details: DataFrame, overrides: DataFrame) -> DataFrame:
    """Reach of each entity: attack range times speed plus, over up to four spells,
    capped range over floored cooldown.

    ``details`` has (entity, attack_range, attack_speed, spells array<struct<id,
    range, cooldown>>), ``overrides`` (entity, spell, reach): a null reach leaves a
    spell out, no row leaves it as it is. Without cooldowns there is no throttle.
    """
    spells = details.select("entity", F.explode_outer(F.slice("spells", 1, ACTIVE_SPELLS)).alias("s"))
    marked = overrides.select("entity", F.col("spell"), F.col("reach"), F.lit(True).alias("_over"))
    rows = spells.withColumn("spell", F.col("s.id")).join(marked, ["entity", "spell"], "left")
    over = F.coalesce("_over", F.lit(False))
    reach = F.least(F.when(over, F.col("reach")).otherwise(F.array_max("s.range")), F.lit(RANGE_CAP))
    left_out = over & F.col("reach").isNull()
    positive = F.array_min(F.filter("s.cooldown", lambda c: c > 0))
    wait = F.when(F.col("s.cooldown").isNull(), F.lit(1.0)).otherwise(F.greatest(F.coalesce(positive, F.lit(MIN_COOLDOWN)), F.lit(MIN_COOLDOWN)))
    rate = F.when(left_out | F.col("s").isNull(), F.lit(0.0)).otherwise(reach / wait)
    totals = rows.groupBy("entity").agg(F.sum(rate).alias("_spells"))
    return details.join(totals, "entity").select("entity", (F.col("attack_range") * F.col("attack_speed") + F.col("_spells")).alias("score"))


def validate_reference(theory: DataFrame, real: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row n, pearson, spearman; rank gaps at both ends; entities of one side
    only) of theoretical scores against real averages (entity, value)."""
    both = theory.join(real, "entity").select("entity", "score", "value")
    one = both.agg(F.count("*").alias("n"), pearson("score", "value").alias("pearson"))
    summary = one.join(F.broadcast(spearman(both, "score", "value")))  # one row each
    left = theory.join(real, "entity", "left_anti").select("entity", F.lit("theory").alias("only_in"))
    right = real.join(theory, "entity", "left_anti").select("entity", F.lit("real").alias("only_in"))
    return summary, rank_gap(both, "score", "value", k), left.unionByName(right)
