from synergist.plans import queries
from synergist.plans.views import facts

D = "/root/testdata/sf0.001"


def test_facts_hold_every_order(spark):
    n = spark.read.parquet(f"{D}/orders.parquet").count()
    assert facts(spark, D, "m").count() == n
    assert facts(spark, D, "p").count() == 10 * n and facts(spark, D, "t").count() == 2 * n


def test_newest_periods_are_chosen_among_more(spark):
    periods = {r.period for r in facts(spark, D, "m").select("period").distinct().collect()}
    assert {"16.6", "16.7", "16.8", "16.9", "16.10", "16.11", "16.12"} == periods
    window = queries.window_definition(spark, D).orderBy("depth").collect()
    assert [r.period for r in window] == ["16.12", "16.11", "16.10"]
    assert {r.period for r in queries.keep_newest(spark, D).collect()} == {"16.12", "16.11"}
