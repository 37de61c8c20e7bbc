from pyspark.sql import functions as F

from synergist.plans import aggregates
from synergist.plans.views import facts
from synergist.sources import tables

D = "/root/testdata/sf0.001"


def test_refresh_replaces_its_periods_only(spark, tmp_path):
    m, p, t = (facts(spark, D, x) for x in "mpt")
    names = ("individual", "matchup", "trio")
    read = lambda n: {r.period: (r.n, r.g) for r in tables.read(spark, f"{tmp_path}/{n}").groupBy("period").agg(F.count("*").alias("n"), F.sum("games").alias("g")).collect()}
    aggregates.refresh(m, p, t, p, ["16.9", "16.10"], str(tmp_path), names)
    first = {n: read(n) for n in names}
    assert set(first["trio"]) == {"16.9", "16.10"}
    aggregates.refresh(m, p, t, p, ["16.10"], str(tmp_path), names)
    assert {n: read(n) for n in names} == first  # the same rows again, the other period untouched
    half = [x.where("event_id % 2 = 0") for x in (m, p, t)]
    aggregates.refresh(half[0], half[1], half[2], half[1], ["16.10"], str(tmp_path), names)
    after = {n: read(n) for n in names}
    for n in names:
        assert after[n]["16.9"] == first[n]["16.9"] and after[n]["16.10"][1] < first[n]["16.10"][1]
