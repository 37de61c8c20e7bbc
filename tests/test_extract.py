"""Extraction from built documents with known facts."""

import json

import pytest

from synergist.operators import extract as E
from synergist.plans.aggregates import build_aggregates
from synergist.plans.extract import extract

SLOTS = ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"]


def detail(event="NA1_1", winner=100, duration=1800, queue=420):
    people = []
    for pid in range(1, 11):
        i = (pid - 1) % 5
        people.append(
            dict(participantId=pid, puuid=f"p{pid}", teamId=100 if pid <= 5 else 200, teamPosition=SLOTS[i], championId=pid if pid <= 5 else 11 + i, win=(pid <= 5) == (winner == 100), visionScore=pid,
                 timeCCingOthers=2 * pid, totalDamageDealtToChampions=1000 * pid, goldEarned=1000 + 200 * pid, wardsPlaced=pid + 10, wardsKilled=pid, challenges=dict(turretPlatesTaken=1))
        )
    return dict(metadata=dict(matchId=event), info=dict(queueId=queue, gameVersion="16.13.1.2", gameCreation=1_700_000_000_000, gameDuration=duration, gameEndTimestamp=1, teams=[dict(teamId=100, win=winner == 100), dict(teamId=200, win=winner == 200)], participants=people))


def timeline(event="NA1_1", minutes=30, events=()):
    frames = []
    for m in range(minutes + 1):
        people = {str(p): dict(totalGold=m * (100 + p), jungleMinionsKilled=m * p) for p in range(1, 11)}
        frames.append(dict(timestamp=m * 60_000, participantFrames=people, events=[e for e in events if e["timestamp"] // 60_000 == m]))
    return dict(metadata=dict(matchId=event), info=dict(frames=frames))


EVENTS = [
    dict(type="ELITE_MONSTER_KILL", timestamp=400_000, killerTeamId=100, monsterType="DRAGON", monsterSubType="FIRE_DRAGON"),
    dict(type="ELITE_MONSTER_KILL", timestamp=500_000, killerTeamId=0, monsterType="DRAGON", monsterSubType="AIR_DRAGON"),
    dict(type="BUILDING_KILL", timestamp=700_000, buildingType="TOWER_BUILDING", teamId=100, towerType="OUTER"),
    dict(type="ELITE_MONSTER_KILL", timestamp=1_500_000, killerTeamId=200, monsterType="BARON_NASHOR"),
    dict(type="ELITE_MONSTER_KILL", timestamp=1_600_000, killerTeamId=100, monsterType="BARON_NASHOR"),
    dict(type="CHAMPION_KILL", timestamp=300_000, killerId=2, victimId=7, assistingParticipantIds=[3]),
    dict(type="CHAMPION_KILL", timestamp=310_000, killerId=1, victimId=7),
    dict(type="CHAMPION_KILL", timestamp=320_000, killerId=0, victimId=9),
    dict(type="WARD_PLACED", timestamp=100_000, creatorId=6),
    dict(type="WARD_KILL", timestamp=1_000_000, killerId=6),
]


@pytest.fixture(scope="module")
def facts(spark):
    docs = [detail(), detail("NA1_2", 200, 250), detail("NA1_3", queue=1), detail("NA1_4"), detail("NA1_5")]
    docs[3]["info"]["participants"][0]["teamPosition"] = "JUNGLE"
    lines = [timeline(events=EVENTS), timeline("NA1_2"), timeline("NA1_3"), timeline("NA1_4")]
    read = lambda rows, schema: spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").selectExpr(f"from_json(j, '{schema}') as d").select("d.*")
    from pyspark.sql import functions as F

    flat = lambda s: " ".join(s.split())
    got = extract(read(docs, flat(E.DETAIL)).withColumn("segment", F.lit("na1")), read(lines, flat(E.TIMELINE)), "16.13")
    return {k: v.cache() for k, v in got.items()}


def test_quarantine(facts):
    got = {(r.event_id, r.status, r.reason) for r in facts["quarantine"].collect()}
    assert got == {("NA1_2", "excluded", "duration"), ("NA1_3", "excluded", "queue"), ("NA1_4", "error_retryable", "structure"), ("NA1_5", "error_retryable", "timeline")}


def test_events_and_picks(facts):
    e = facts["events"].collect()
    assert [(r.event_id, r.period, r.duration_s, r.winner) for r in e] == [("NA1_1", "16.13", 1800, 100)]
    assert facts["picks"].count() == 10


def test_side_facts(facts):
    a, b = sorted(facts["sides"].collect(), key=lambda r: r.side)
    assert (a.jgl, a.mid, a.sup, a.win, b.jgl) == (2, 3, 5, True, 12)
    assert a.gold_diff_10 == 10 * ((102 + 103 + 105) - (107 + 108 + 110)) and a.gold_diff_35 is None
    assert (a.jgl_cs_diff_15, b.jgl_cs_diff_15) == (15 * (2 - 7), 15 * (7 - 2))
    assert (a.drakes_taken, a.dragons_taken_pre15, b.first_tower, a.first_tower, b.nashor_first, a.nashor_first, b.nashor_first_s) == (1, 1, True, False, True, False, 1500)
    assert a.kill_participation_pre15 == pytest.approx(1 / 3) and b.kill_participation_pre15 is None
    assert (a.vision_score, a.cc_time_s, a.plates_taken, b.wards_pre15) == (10, 20, 5, 1)
    assert a.damage_share == pytest.approx(10 / 15)


def test_role_facts(facts):
    got = {(r.side, r.slot): r for r in facts["roles"].collect()}
    assert len(got) == 10
    r = got[100, "JUNGLE"]
    assert (r.gold_15, r.gold_35, r.entity, r.win) == (15 * 102, None, 2, True)
    assert r.kp_pre15 == pytest.approx(1 / 3) and got[200, "TOP"].kp_pre15 is None


def test_objectives_are_ordered(facts):
    rows = facts["objectives"].orderBy("seq").collect()
    assert [(r.seq, r.event_type, r.subtype, r.side) for r in rows] == [(1, "DRAGON", "infernal", 100), (2, "TOWER", "OUTER", 200), (3, "BARON", None, 200), (4, "BARON", None, 100)]


def test_aggregates_of_extracted_facts(facts):
    got = build_aggregates(facts["events"], facts["picks"], facts["sides"], facts["roles"])
    assert {k: got[k].count() for k in ("individual", "duo", "trio", "trio_duration", "matchup")} == {"individual": 10, "duo": 20, "trio": 2, "trio_duration": 2, "matchup": 10}
    t = got["trio"].where("jgl = 2").first()
    assert (t.vision_sum, t.vision_n) == (pytest.approx(10 / 30), 1)
