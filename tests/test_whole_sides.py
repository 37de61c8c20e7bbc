"""Whole side rows equal the joined ones, and scores come from them without a shuffle by event."""

from pyspark.sql import functions as F

from synergist.operators import aggregates as A
from synergist.plans import aggregates, factors, queries, scores
from synergist.plans.views import facts, whole_sides
from synergist.sources import scratch

D = "/root/testdata/sf0.001"


def same(x, y):
    return x.dtypes == y.dtypes and not x.exceptAll(y).take(1) and not y.exceptAll(x).take(1)


def test_whole_sides_are_the_joined_ones(spark):
    m, p, t = (facts(spark, D, x) for x in "mpt")
    joined, whole = aggregates.side_rows(t, p.drop("period", "segment", "duration_s"), m), whole_sides(spark, D)
    plain = [c for c in joined.columns if c not in ("own", "enemy")]
    flat = lambda x: x.select(*plain, *(F.element_at(w, F.lit(s))[c].alias(f"{w}_{s}_{c}") for w in ("own", "enemy") for s in A.SLOTS for c in A.ROLE_STATS))
    assert set(joined.columns) == set(whole.columns) and same(flat(joined), flat(whole))
    first = lambda x: x.select("event_id", "side", "slot", "first_blood")
    assert same(first(p), first(A.seats(whole, ["event_id", "side"], ("first_blood",))))


def test_aggregates_of_sides_are_those_of_facts(spark):
    m, p, t = (facts(spark, D, x) for x in "mpt")
    old, new = aggregates.build_aggregates(m, p, t, p), aggregates.aggregates_of_sides(whole_sides(spark, D))
    assert set(old) == set(new)
    for name in old:
        assert same(queries.rounded(old[name], 4), queries.rounded(new[name], 4)), name


def test_nothing_is_shuffled_by_event(spark):
    for name, got in aggregates.aggregates_of_sides(whole_sides(spark, D)).items():
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(period" in plan and "Join" not in plan and "hashpartitioning(event_id" not in plan, name


def test_duration_counts_write_no_facts(spark, monkeypatch):
    wrote = []
    keep = queries.checkpointed
    monkeypatch.setattr(queries, "checkpointed", lambda df: wrote.append(df.columns) or keep(df))
    queries.duration_counts(spark, D)
    assert wrote and not any("event_id" in c for c in wrote)


def test_gold_rows_of_sides_are_those_of_facts(spark):
    m, p, t = (facts(spark, D, x) for x in "mpt")
    window = queries._window(spark, D)
    one, match = A.individual(p), queries._matchup_scores(spark, D)
    trios = t.select(F.lit("all").alias("segment"), *A.TRIO).distinct().withColumn("synergy", F.col("jgl") / 7)
    old = factors.gold_rows(p, t, m, window, one, match, trios)
    new = factors.gold_rows_of_sides(whole_sides(spark, D), window, one, match, trios)
    assert old.count() and same(queries.rounded(old), queries.rounded(new))


def test_pair_scores_write_and_shuffle_no_events(spark, monkeypatch):
    wrote = []

    def kept(df):
        wrote.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return scratch.checkpointed(df)

    for module in (queries, scores):
        monkeypatch.setattr(module, "checkpointed", kept)
    got = queries._scores(spark, D)
    assert len(wrote) == 5  # window, three aggregates, rates of the combinations
    for columns, plan in [*wrote, (got.columns, got._jdf.queryExecution().executedPlan().toString())]:
        assert "event_id" not in columns and "hashpartitioning(event_id" not in plan
        assert "SortMergeJoin" not in plan or "orders.parquet" not in plan
