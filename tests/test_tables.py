import pytest
from pyspark.sql import functions as F

from synergist.operators import filters, joins
from synergist.operators import ranking as R
from synergist.operators import reference as ref
from synergist.plans import compose
from synergist.sources import readers, sinks, tables
from synergist.streaming import ingest


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "16.1"), (2, "16.1"), (2, "16.1")], "k long, period string")
    assert sinks.append_new(df, f"{tmp_path}/t", ["k"]).count() == 2
    assert sinks.append_new(df, f"{tmp_path}/t", ["k"]).count() == 0
    assert readers.scan_facts(spark, f"{tmp_path}/t", ["16.1"]).count() == 2


def test_refresh_leaves_other_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.refresh_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v long, period string"), path)
    sinks.refresh_partitions(spark.createDataFrame([(9, "a")], "v long, period string"), path)
    assert {(r.v, r.period) for r in tables.read(spark, path).collect()} == {(9, "a"), (2, "b")}


def test_upsert_writes_changes_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    schema = "k long, v long, label string"
    sinks.upsert(spark.createDataFrame([(1, 1, "a"), (2, None, "a"), (3, 3, "b")], schema), path, ["k"], "label")
    change = sinks.upsert(spark.createDataFrame([(1, 1, "a"), (2, 5, "a"), (4, 4, "a")], schema), path, ["k"], "label")
    assert {r.k for r in change.collect()} == {2, 4}
    assert {(r.k, r.v) for r in tables.read(spark, path).collect()} == {(1, 1), (2, 5), (3, 3), (4, 4)}


def test_retention_cascades(spark):
    events = spark.createDataFrame([("e1", "16.9"), ("e2", "16.10"), ("e3", "16.11")], "event_id string, period string")
    child = spark.createDataFrame([("e1",), ("e1",), ("e3",)], "event_id string")
    kept, counts = sinks.purge({"events": events, "child": child}, "period", 2, "event_id", dry_run=False)
    assert {r["table"]: r.n for r in counts.collect()} == {"events": 1, "child": 2}
    assert kept["child"].count() == 1
    whole, _ = sinks.purge({"events": events, "child": child}, "period", 2, "event_id")
    assert whole["child"].count() == 3


def test_commented_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿a,b\n# note\n1,x\n", encoding="utf-8")
    rows = readers.load_reference(spark, f"{tmp_path}/r.csv")
    assert rows.columns == ["a", "b"] and [tuple(r) for r in rows.collect()] == [("1", "x")]


def test_filters(spark):
    df = spark.createDataFrame([(1, "moyen", "x"), (5, "eleve", "y")], "games int, tier string, segment string")
    assert filters.segment_filter(df, "all").count() == 2 and filters.segment_filter(df, "x").count() == 1
    assert filters.tier_at_least(df, "eleve").count() == 1
    assert filters.range_filter(df, {"games": 2}, {}, ["games"]).count() == 1
    with pytest.raises(ValueError):
        filters.range_filter(df, {"nope": 2}, {}, ["games"])
    assert filters.check_weights({"a": 60, "b": 40.2}) == {"a": 0.6, "b": 0.402}
    assert filters.check_weights({"a": None}) is None
    with pytest.raises(ValueError):
        filters.check_weights({"a": 60})


def test_anti_joins(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    assert {r.k for r in joins.not_done(ids, ids.where("k = 1"), ids.where("k = 2"), "k").collect()} == {3}
    assert joins.unknown(ids, ids.where("k < 3"), ["k"]).count() == 1


def test_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (1, 3)], "v int, k int")
    assert [r.k for r in R.sort_nulls_last(df, "v", True, ["k"]).collect()] == [2, 3, 1]
    assert [r.k for r in R.sort_nulls_last(df, "v", False, ["k"]).collect()] == [3, 2, 1]
    rows, total = R.page(df, R.order_columns(["v"], ["desc"], ["k"]), 2, 2)
    assert [r.k for r in rows.collect()] == [1] and total.first().total == 3


def test_overrides_consume_in_order(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 30)], "k string, o int, v int")
    edits = spark.createDataFrame([("a", 1, 99, "set"), ("a", 2, None, "exclude"), ("c", 9, 5, "add")], "k string, o int, v int, action string")
    got = ref.apply_overrides(rows, edits, ["k"], ["v"], ["o"])
    assert {(r.k, r.v) for r in got.collect()} == {("a", 99), ("b", 30), ("c", 5)}


def test_markup_and_fields(spark):
    page = spark.createDataFrame([("p", "== Head ==\n* {{x|one}} *\n* {{x|one}} {{x|two}}\n== Next ==\n{{x|one}}")], "k string, t string")
    got = ref.markup_entries(page, "k", "t", r"^== (.*) ==$", r"\{\{x\|(\w+)\}\}", r"\*$")
    assert {(r.category, r.entry, r.flagged) for r in got.collect()} == {("Head", "one", True), ("Head", "two", False), ("Next", "one", False)}
    text = spark.createDataFrame([("{{a\n|cool = 12 to 8.5\n|none =\n}}",)], "t string")
    row = text.select(ref.template_field(F.col("t"), "cool").alias("c"), ref.template_field(F.col("t"), "none").alias("n"), ref.min_number(ref.template_field(F.col("t"), "cool")).alias("m")).first()
    assert (row.c, row.n, row.m) == ("12 to 8.5", None, 8.5)


def test_quarantine_attempts(spark):
    fail = spark.createDataFrame([("e", "error_retryable")], "event_id string, status string")
    j = None
    for _ in range(2):
        j = ingest.merge_quarantine(j, fail)
    assert [tuple(r) for r in j.collect()] == [("e", "error_retryable", 2)]
    assert [tuple(r) for r in ingest.merge_quarantine(j, fail).collect()] == [("e", "error_permanent", 3)]
    ok = fail.withColumn("status", F.lit("ok"))
    assert ingest.merge_quarantine(j, ok).count() == 0


def test_completion_prefers_best_and_keeps_locked(spark):
    rows = []
    for roles, _ in compose.PAIRS.items():
        for a in (1, 2):
            for b in (1, 2):
                rows.append(("all", roles, a, b, 100, 100.0, 0.5, 0.1 * (a == b) + 0.01 * (a == 2)))
    duos = spark.createDataFrame(rows, "segment string, roles string, a long, b long, games long, games_eff double, rate double, synergy double")
    duos = duos.withColumns({c: F.lit(1.0) for c in ("scaling", "cc_time_s", "gold_diff_15", "drakes", "soul_rate", "range_theoretical_pct", "ci_low", "ci_high")})
    profiles = compose.profile_table(duos, {"synergy": {"synergy": 1.0}})
    picks = spark.createDataFrame([("all", "synergy", "mine", "TOP", 1)], "segment string, archetype string, seed string, slot string, entity long")
    start = compose.requested(picks, duos).drop("unknown_pairs")
    done = compose.complete(start, duos, profiles, 10)
    assert set(done.first().placed.values()) == {1}
    kept = compose.refine(done, duos, profiles, 10, locked=["TOP"])
    assert kept.first().placed["TOP"] == 1
    flat = compose.to_flat(kept)
    assert compose.to_nested(flat).first().placed == kept.first().placed


def test_upsert_moves_rows_between_partitions(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "k long, v long, label string"
    sinks.upsert(spark.createDataFrame([(1, 1, "16.10"), (2, 2, "16.9"), (3, 3, None), (4, 4, None), (5, 5, "lone/ly")], schema), path, ["k"], "label")
    change = sinks.upsert(spark.createDataFrame([(1, 1, "16.9"), (3, 9, None), (5, 5, "16.9"), (5, 5, "16.9")], schema), path, ["k"], "label")
    assert {r.k for r in change.collect()} == {1, 3, 5}
    got = {(r.k, r.v, r.label) for r in tables.read(spark, path).collect()}
    assert got == {(1, 1, "16.9"), (2, 2, "16.9"), (3, 9, None), (4, 4, None), (5, 5, "16.9")}


def test_repeated_keys_are_settled_by_an_order(spark):
    left = spark.createDataFrame([(1, None, "n")], "k long, v double, note string")
    many = spark.createDataFrame([(1, 2.0), (1, 5.0), (1, None)], "k long, v double").repartition(3)
    assert [tuple(r) for r in joins.enrich(left.select("k"), many, ["k"], ["v"]).collect()] == [(1, 5.0)]
    assert [tuple(r) for r in ref.fill_from(left, many, ["k"], ["v"]).collect()] == [(1, 5.0, "n;filled:v")]
    assert [tuple(r) for r in sinks.backfill(left, many, ["k"], ["v"]).collect()] == [(1, 5.0, "n")]
    assert [tuple(r) for r in sinks.new_rows(many, None, ["k"]).collect()] == [(1, 2.0)]


def test_ranks_across_ranges(spark):
    import random

    rng = random.Random(0)
    values = [rng.choice([None, *range(40)]) for _ in range(500)]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i long, x double")
    key = lambda v: -1 if v is None else v
    want = {i: sum(key(u) < key(v) for u in values) + (sum(u == v for u in values) + 1) / 2 for i, v in enumerate(values)}
    assert {r.i: r["rank"] for r in R.avg_rank(df, "x").collect()} == want


def test_advice_thresholds_are_strict_but_for_control(spark):
    from synergist.functions import columns as C

    rows = [(0.03, 2.5, 350.0), (-0.03, 2.49, -350.0), (0.031, 2.6, 351.0), (-0.031, None, -351.0)]
    got = spark.createDataFrame(rows, "s double, c double, g double").select(C.advice("s", "c", "g").alias("a")).collect()
    assert [r.a for r in got] == [["control"], [], ["late", "control", "lead"], ["early", "patience"]]


def test_periods_keep_their_types(spark, tmp_path):
    """A failing case of the review: '16.1' and '16.10' were both returned as 16.1."""
    path, schema = f"{tmp_path}/t", "v long, period string"
    sinks.refresh_partitions(spark.createDataFrame([(1, "16.1"), (2, "16.9"), (3, "16.10"), (4, None)], schema), path)
    for period, v in (("16.1", 1), ("16.9", 2), ("16.10", 3)):
        assert [tuple(r) for r in readers.scan_facts(spark, path, [period]).collect()] == [(v, period)]
    some = readers.scan_facts(spark, path, ["16.10", "16.9"])
    assert {tuple(r) for r in some.collect()} == {(3, "16.10"), (2, "16.9")}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "period#" in plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0] and "DataFilters: []" in plan
    assert [r.v for r in tables.read(spark, path, [None]).collect()] == [4]


def test_refresh_to_nothing_leaves_nothing(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "v long, period string"
    sinks.refresh_partitions(spark.createDataFrame([(1, "a"), (2, "b")], schema), path)
    for _ in range(2):
        sinks.refresh_partitions(spark.createDataFrame([], schema), path, values=["a"])
        assert [tuple(r) for r in tables.read(spark, path).collect()] == [(2, "b")]
    labels = f"{tmp_path}/w"
    rows = spark.createDataFrame([(1, "x+y", "eu"), (2, "x+y", "na"), (3, "z", "eu")], "v long, label string, segment string")
    sinks.replace_window(rows, labels, ["x+y", "z"], ["segment"])
    sinks.replace_window(rows.where("v = 2"), labels, ["x+y"], ["segment"])
    assert {r.v for r in tables.read(spark, labels).collect()} == {2, 3}
    sinks.replace_window(rows.limit(0), labels, ["x+y"], ["segment"])
    assert {r.v for r in tables.read(spark, labels).collect()} == {3}
    dim = f"{tmp_path}/d"
    for n in (3, 2, 0):
        sinks.replace_all(rows.limit(n), dim)
        assert tables.read(spark, dim).count() == n == tables.row_count(spark, dim)


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "v long, period string"
    sinks.refresh_partitions(spark.createDataFrame([(1, "a"), (2, "b")], schema), path)
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("v"), F.lit("a").alias("period"))
    at = tables.version(spark, path)
    with pytest.raises(Exception, match="stop"):
        sinks.refresh_partitions(bad, path)
    assert tables.version(spark, path) == at and {tuple(r) for r in tables.read(spark, path).collect()} == {(1, "a"), (2, "b")}
    # what a writer that died left of its version doesn't stop the next one
    (tmp_path / "t" / "manifest" / f"version={at + 1}").mkdir()
    sinks.refresh_partitions(spark.createDataFrame([(7, "a")], schema), path)
    assert {tuple(r) for r in tables.read(spark, path).collect()} == {(7, "a"), (2, "b")}
    assert tables.vacuum(spark, path) > 0 and tables.read(spark, path).count() == 2
    with pytest.raises(ValueError, match="columns differ"):
        tables.append(spark.createDataFrame([(7,)], "v long"), path, ["period"])


def test_null_keys_are_keys(spark, tmp_path):
    """Three identical calls stored 2, 3 and 4 rows before."""
    rows = spark.createDataFrame([(1, "a", "p"), (None, "b", "p"), (None, "b", "p")], "k long, v string, period string")
    for _ in range(3):
        sinks.append_new(rows, f"{tmp_path}/a", ["k"])
        assert tables.read(spark, f"{tmp_path}/a").count() == 2
        sinks.upsert(rows, f"{tmp_path}/u", ["k"], "period")
        assert tables.read(spark, f"{tmp_path}/u").count() == 2
    assert sinks.append_new(rows, f"{tmp_path}/a", ["k"], scoped=True).count() == 0
    changed = sinks.upsert(rows.withColumn("v", F.lit("z")), f"{tmp_path}/u", ["k"], "period")
    assert changed.count() == 2 and {r.v for r in tables.read(spark, f"{tmp_path}/u").collect()} == {"z"}
    merged = sinks.merge_columns(rows.withColumn("v", F.lit("n")), rows.drop_duplicates(), ["k"], ["period"])
    assert sorted((str(r.k), r.v) for r in merged.collect()) == [("1", "n"), ("None", "n")]


def test_retention_of_stored_tables(spark, tmp_path):
    root = str(tmp_path)
    events = spark.createDataFrame([(i, f"16.{1 + i % 12}") for i in range(48)], "event_id long, period string")
    tables.append(events, f"{root}/events", ["period"])
    tables.append(events.withColumn("x", F.lit(1)), f"{root}/sides", ["period"])
    tables.append(events.select("event_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq")), f"{root}/log", [])
    want = {"events": 40, "sides": 40, "log": 120}
    files = lambda: len(list(tmp_path.rglob("part-*.parquet")))
    before = files()
    assert sinks.purge_stored(spark, root, "events", ["sides", "log"], 2) == want
    assert tables.read(spark, f"{root}/events").count() == 48 and files() >= before
    assert sinks.purge_stored(spark, root, "events", ["sides", "log"], 2, dry_run=False) == want
    kept = {r.event_id for r in tables.read(spark, f"{root}/events").collect()}
    assert {r.period for r in tables.read(spark, f"{root}/events").collect()} == {"16.11", "16.12"}
    for name in ("sides", "log"):
        assert {r.event_id for r in tables.read(spark, f"{root}/{name}").collect()} == kept
    # the old rows are gone from disk too
    stored = [str(f) for f in tmp_path.rglob("part-*.parquet") if "/data/" in str(f)]
    assert stored and not any(f"period=16.{k}/" in f for f in stored for k in range(1, 11))
    assert sinks.purge_stored(spark, root, "events", ["sides", "log"], 2, dry_run=False) == {"events": 0, "sides": 0, "log": 0}


def test_an_extract_is_stored_once(spark, tmp_path):
    facts = {"events": spark.createDataFrame([(1, "16.1"), (2, "16.10")], "event_id long, period string"), "sides": spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "event_id long, side int")}
    keys = {"sides": ["event_id", "side"]}
    assert sinks.insert_event(facts, str(tmp_path), keys).count() == 2
    assert sinks.insert_event(facts, str(tmp_path), keys).count() == 0
    assert tables.read(spark, f"{tmp_path}/sides").count() == 3 and tables.read(spark, f"{tmp_path}/events", ["16.10"]).count() == 1
