"""The rebuild of aggregates runs in methods that HotSpot compiles, and leaves the session as it was."""

import pytest

from synergist.plans import aggregates
from synergist.plans.views import whole_sides

D = "/root/testdata/sf0.001"


def test_rebuild_bounds_the_methods_of_its_stages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(aggregates, "refresh_partitions", lambda df, path, *a: seen.append((path, spark.conf.get(aggregates.HUGE_METHOD))))
    before = spark.conf.get(aggregates.HUGE_METHOD)
    aggregates.refresh_from_sides(whole_sides(spark, D), ["16.3"], "r", ("duo", "trio"))
    assert seen == [("r/duo", "8000"), ("r/trio", "8000")] and spark.conf.get(aggregates.HUGE_METHOD) == before != "8000"


def test_session_is_restored_after_an_error(spark):
    spark.conf.set(aggregates.HUGE_METHOD, "60000")
    try:
        with pytest.raises(ValueError), aggregates.compiled(spark):
            raise ValueError
        assert spark.conf.get(aggregates.HUGE_METHOD) == "60000"
    finally:
        spark.conf.unset(aggregates.HUGE_METHOD)
