"""Idempotent sinks over stored tables (see ``tables``) partitioned by period or window
label. Keys match null-safely: a null key is a key like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import period_key
from . import tables
from .scratch import checkpointed


def same_key(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``left`` joined with the keys of ``right``, null keys matching null ones (a semi
    or an anti join)."""
    named = right.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)))
    return left.join(named, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], how)


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the first in the order of the columns. Columns without an
    order (maps) count by their JSON."""
    if set(df.columns) <= set(keys):
        return df.select(*(f"`{c}`" for c in df.columns)).distinct()
    ordered = lambda c: F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in df.schema[c].dataType.simpleString() else F.col(f"`{c}`")
    others = [c for c in df.columns if c not in keys]
    order = F.struct(*(x for c in others for x in (F.col(f"`{c}`").isNull(), ordered(c))))
    best = F.min_by(F.struct(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others))), order).alias("_row")
    got = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(best)
    value = {c: F.col(f"_row._{i}") for i, c in enumerate(others)}
    return got.select(*(value.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns))


def new_rows(df: DataFrame, target: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose key the target doesn't hold, one for each key (see ``first_rows``)."""
    rows = df if target is None else same_key(df, target, keys, "left_anti")
    return first_rows(rows, keys)


def append_new(df: DataFrame, path: str, keys: list[str], partition: str | None = "period", scoped: bool = False) -> DataFrame:
    """Append the rows whose key isn't stored (repeats do nothing); returns them.

    With ``scoped`` a key never moves between partitions, so only the partitions that
    ``df`` has rows of are searched for it.
    """
    spark = df.sparkSession
    values = None
    if scoped and partition:
        values = [r[0] for r in df.select(partition).distinct().collect()]  # the batch's partitions
    fresh = checkpointed(new_rows(df, tables.read(spark, path, values), keys))
    if fresh.take(1) or tables.version(spark, path) < 0:
        tables.append(fresh, path, [partition] if partition else [])
    return fresh


def insert_event(facts: dict[str, DataFrame], root: str, keys: dict[str, list[str]]) -> DataFrame:
    """Append an extract's fact tables; an event that is stored already adds nothing
    to any of them. Returns the new event rows."""
    spark = facts["events"].sparkSession
    events = checkpointed(new_rows(facts["events"], tables.read(spark, f"{root}/events"), ["event_id"]))
    for name, df in facts.items():
        if name in ("events", "quarantine"):
            continue
        # children first: an interrupted run leaves no event without its facts
        append_new(df.join(events.select("event_id"), "event_id", "left_semi"), f"{root}/{name}", keys[name], None)
    tables.append(events, f"{root}/events", ["period"])
    return events


def refresh_partitions(df: DataFrame, path: str, partition: str = "period", values: list | None = None) -> None:
    """Replace the partitions that ``df`` has rows for, and those of ``values`` whether
    it has rows for them or not."""
    tables.replace(df, path, [partition], values)


def replace_window(df: DataFrame, path: str, labels: list[str], extra: list[str] | None = None) -> None:
    """Replace all rows of the window ``labels`` by those of ``df``, none if it has none."""
    tables.replace(df, path, ["label", *(extra or [])], labels)


def replace_all(df: DataFrame, path: str) -> None:
    """Replace the whole table."""
    tables.replace(df, path, [])


def changed_rows(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows that are new or differ from the target in any value column
    (null-safe, keys too)."""
    values = [c for c in source.columns if c not in keys]
    old = target.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*values).alias("_old"), F.lit(True).alias("_there"))
    rows = source.join(old, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    same = F.coalesce("_there", F.lit(False))
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_old.{v}"))
    return rows.where(~same).select(*source.columns)


def upsert(source: DataFrame, path: str, keys: list[str], partition: str) -> DataFrame:
    """Write new and changed rows, one for each key (see ``first_rows``). Only the
    partitions that they come to or leave are rewritten, that of null values among them;
    one that loses all its rows goes. Returns the change set."""
    spark = source.sparkSession
    target = tables.read(spark, path)
    source = first_rows(source, keys)
    if target is None:
        tables.replace(source, path, [partition])
        return source
    change = checkpointed(changed_rows(source, target, keys))
    left = same_key(target, change, keys, "left_semi").select(partition)
    parts = [r[0] for r in change.select(partition).union(left).distinct().collect()]  # the partitions that change
    if parts:
        rest = same_key(tables.read(spark, path, parts), change, keys, "left_anti")
        tables.replace(rest.unionByName(change), path, [partition], parts)
    return change


def merge_columns(source: DataFrame, target: DataFrame, keys: list[str], keep_old: list[str]) -> DataFrame:
    """Full outer merge: new values win, but columns in ``keep_old`` keep the stored
    value where there is one (an upsert that preserves a column). Of source rows that
    repeat a key the first counts; null keys match each other."""
    old, new = target.alias("o"), first_rows(source, keys).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    rows = old.join(new, on, "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep_old else F.coalesce(f"n.{c}", f"o.{c}")
    return rows.select(*(pick(c).alias(c) for c in target.columns))


def backfill(target: DataFrame, corrected: DataFrame, keys: list[str], columns: list[str], only_null: bool = False) -> DataFrame:
    """Target rows with columns recomputed from ``corrected``; with ``only_null``
    just the unknown ones are filled. Rows without a correction stay; of corrections
    that repeat a key, the largest counts."""
    fix = corrected.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_f")).select(*keys, *(F.col(f"_f.{c}").alias(f"_new_{c}") for c in columns))
    rows = target.join(fix, keys, "left")
    value = lambda c: F.coalesce(c, f"_new_{c}") if only_null else F.coalesce(f"_new_{c}", c)
    return rows.withColumns({c: value(c) for c in columns}).select(*target.columns)


def stale_keys(df: DataFrame, column: str, keep: int) -> DataFrame:
    """Values beyond the newest ``keep``, by numeric period order; window labels
    count by their newest period, then by depth."""
    parts = F.split(column, r"\+")
    order = [period_key(F.get(parts, F.lit(0))).desc(), F.size(parts).desc()]
    return df.select(column).distinct().withColumn("_r", F.row_number().over(Window.orderBy(*order))).where(F.col("_r") > keep).select(column)


def purge(tables: dict[str, DataFrame], column: str, keep: int, by: str, dry_run: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """Retention over several tables: those with ``column`` lose its stale values,
    the others the rows whose parent ``by`` went (cascade). Returns the kept tables
    and the counts of rows that go; with ``dry_run`` the tables come back whole."""
    parent = next(t for t in tables.values() if column in t.columns and by in t.columns)
    old = stale_keys(parent, column, keep)
    gone = parent.join(old, column, "left_semi").select(by)
    kept, counts = {}, None
    for name, t in tables.items():
        on, keys = (column, old) if column in t.columns else (by, gone)
        kept[name] = t if dry_run else t.join(keys, on, "left_anti")
        n = t.join(keys, on, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def purge_stored(spark: SparkSession, root: str, parent: str, children: list[str], keep: int, by: str = "event_id", dry_run: bool = True) -> dict[str, int]:
    """Retention of stored tables: ``parent``, partitioned by period, keeps its newest
    ``keep`` periods; the others go with the manifest's entries alone. Of ``children`` the
    rows go whose parent does: by partition too where they have the periods, else
    their rest is written anew. Returns the rows that go by table; with ``dry_run``
    nothing changes. Files are deleted in the end (see ``tables.vacuum``)."""
    path = f"{root}/{parent}"
    column = tables.layout(spark, path)[1][0]
    old = [r[0] for r in stale_keys(tables.entries(spark, path), column, keep).collect()]  # a value for each old period
    out = {}
    gone = tables.read(spark, path, old).select(by) if old else None
    for name in children:
        at = f"{root}/{name}"
        partition = tables.layout(spark, at)[1]
        if not old:
            out[name] = 0
        elif partition[:1] == [column]:
            out[name] = tables.row_count_of(spark, at, old) if dry_run else tables.drop(spark, at, old)
        else:
            rows = tables.read(spark, at)
            before = tables.row_count(spark, at)
            rest = checkpointed(same_key(rows, gone, [by], "left_anti"))
            out[name] = before - rest.count()
            if not dry_run and out[name]:
                tables.replace_everything(rest, at, partition)
    # the parent last: an interrupted run is completed by the next one
    out[parent] = 0 if not old else tables.row_count_of(spark, path, old) if dry_run else tables.drop(spark, path, old)
    if not dry_run:
        for name in (parent, *children):
            tables.vacuum(spark, f"{root}/{name}")
    return out


def validate(df: DataFrame, key: list[str], enums: dict[str, list], parent: DataFrame | None = None, parent_key: str = "event_id") -> DataFrame:
    """Violations of a table's contract: (rule, detail, n). Rules are repeated keys,
    values outside an enumeration (null passes), and rows without a parent."""
    name = lambda cols: F.concat_ws("|", *(F.col(c).cast("string") for c in cols))
    out = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("unique").alias("rule"), name(key).alias("detail"), "n")
    for c, allowed in enums.items():
        bad = df.where(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)).groupBy(F.col(c).cast("string").alias("detail")).agg(F.count("*").alias("n"))
        out = out.unionByName(bad.select(F.lit(f"enum:{c}").alias("rule"), "detail", "n"))
    if parent is not None:
        orphans = df.join(parent.select(parent_key), parent_key, "left_anti").groupBy(F.col(parent_key).cast("string").alias("detail")).agg(F.count("*").alias("n"))
        out = out.unionByName(orphans.select(F.lit("parent").alias("rule"), "detail", "n"))
    return out
