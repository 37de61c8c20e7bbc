"""Facts of documents that come in one row equal those of joined documents, and no document is written."""

from pyspark.sql import functions as F

from synergist.operators import extract as E
from synergist.operators.aggregates import SLOTS
from synergist.plans import documents as G
from synergist.plans.extract import extract
from synergist.sources import scratch

D = "/root/testdata/sf0.001"


def test_facts_are_those_of_joined_documents_and_no_document_is_written(spark, monkeypatch):
    keep, wrote = G.checkpointed, []
    detail, timeline = (keep(x) for x in G.documents(spark, D))
    old = extract(detail, timeline, reliability=G._sure(spark, D))
    monkeypatch.setattr(G, "checkpointed", lambda df: wrote.extend(df.columns) or keep(df))
    for name in ("events", "quarantine", "picks", "objectives", "roles", "sides"):
        want, got = G._shown(old[name]), G.extract_sides(spark, D) if name == "sides" else G._facts(spark, D, name)
        assert sorted(want.dtypes) == sorted(got.dtypes), name
        got = got.select(*want.columns)
        assert want.count() == got.count() and not want.exceptAll(got).take(1), name
    assert not {"info", "metadata", "timeline"} & set(wrote)


def test_events_join_nothing(spark):
    for name in ("events", "quarantine", "picks"):
        plan = G._facts(spark, D, name)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan, name


def test_members_come_from_their_own_document(spark):
    got = G.extract_members(spark, D)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    want = E.pivot_members(G.extract_picks(spark, D))
    assert got.dtypes == want.dtypes and want.count() == got.count() and not want.exceptAll(got).take(1)


def test_picks_make_only_the_fields_they_read(spark):
    for name in ("events", "quarantine", "picks"):
        plan = G._facts(spark, D, name)._jdf.queryExecution().optimizedPlan().toString()
        assert "9001" not in plan, name  # damage of a participant, which none of them reads


def test_roles_join_an_orders_lines_once(spark):
    plan = G._facts(spark, D, "roles")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "Join Inner" not in plan  # the lines, the reliability


def test_sides_come_from_their_own_document(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(G, "checkpointed", lambda df: wrote.append(df.columns) or scratch.checkpointed(df))
    plan = G.extract_sides(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert not wrote and plan.count("Join LeftOuter") == 4 and "Join Inner" not in plan  # the lines, the reliability of three members
    assert plan.count("Aggregate [") == 1  # the lines of an order


def test_frames_hold_what_is_read(spark):
    all_, some = G.whole_documents(spark, D), G.whole_documents(spark, D, ("people", "log"), ("totalGold", "type", "timestamp"), E.MINUTES)
    assert all_.dtypes == some.dtypes
    frames = lambda x, pick: x.select("metadata.matchId", F.posexplode("timeline.info.frames").alias("m", "f")).select("matchId", "m", "f.timestamp", *pick)
    gold = F.transform_values(F.when(F.col("m").isin(*E.MINUTES), F.col("f.participantFrames")), lambda k, v: v["totalGold"])
    events = F.transform("f.events", lambda e: F.struct(e["type"], e["timestamp"]))
    shown = [F.to_json(gold).alias("gold"), F.to_json(events).alias("events")]
    want, got = frames(all_, shown), frames(some, shown)
    assert want.count() == got.count() and not want.exceptAll(got).take(1)
    assert not frames(some, ["f.participantFrames"]).where(~F.col("m").isin(*E.MINUTES) & F.col("participantFrames").isNotNull()).take(1)


def test_players_read_no_log_and_make_no_timeline(spark):
    got = G.extract_players(spark, D)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "l_partkey" not in plan and "% 41" not in plan and "9001" not in plan  # lines, gold and damage
    want = E.player_ids(G.documents(spark, D)[0])
    assert got.dtypes == want.dtypes and want.count() == got.count() and not want.exceptAll(got).take(1)


def test_structure_of_missing_and_odd_documents(spark):
    seats = [(t, s) for t in (100, 200) for s in SLOTS]
    cases = {"fine": (seats, [100]), "none": (None, [100]), "nine": (seats[:9], [100]), "eleven": ([*seats, seats[0]], [100]), "twice": ([*seats[:9], seats[0]], [100])}
    cases |= {"no_teams": (seats, None), "no_winner": (seats, []), "two": (seats, [100, 200]), "unknown": (seats, [300]), "null_team": (seats, [None])}
    rows = [(k, (p and [dict(teamId=t, teamPosition=s) for t, s in p], w and [dict(teamId=t, win=True) for t in w])) for k, (p, w) in cases.items()]
    docs = spark.createDataFrame(rows, "k string, info struct<participants: array<struct<teamId: int, teamPosition: string>>, teams: array<struct<teamId: int, win: boolean>>>")
    got = {r.k: r.why for r in docs.select("k", E.structure_reason().alias("why")).collect()}
    assert got == {k: None if k == "fine" else "structure" if k in ("none", "nine", "eleven", "twice") else "winner" for k in cases}
