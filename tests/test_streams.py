from datetime import datetime, timedelta
from functools import partial

from pyspark.sql import functions as F

from synergist.streaming import queries as streams

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def write_events(spark, d, parts):
    """A table of one file for each part of (hours, user_id, event_type, value), modified in that order."""
    import os

    k = 0
    for i, part in enumerate(parts):
        rows = [(k + j, START + timedelta(hours=h), u, t, v) for j, (h, u, t, v) in enumerate(part)]
        k += len(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
        for f in (d / "events.parquet").glob("part-*"):
            if f.stat().st_mtime > 1_500_000_000:
                os.utime(f, (1_000_000_000 + 60 * i,) * 2)


def test_open_sessions_come_too(spark, tmp_path):
    # 1.9 hours apart is one session, 2 hours apart are two; the last ones are open
    write_events(spark, tmp_path, [[(0, 1, "a", 0.0), (1.9, 1, "a", 0.0), (3.9, 1, "a", 0.0), (4.5, 1, "a", 0.0), (4.0, 1, "b", 0.0)]])
    got = {(r.event_type, r.start, r.last_seen, r.n) for r in streams.stream_silence(spark, str(tmp_path)).collect()}
    at = lambda h: START + timedelta(hours=h)
    assert got == {("a", at(0), at(1.9), 2), ("a", at(3.9), at(4.5), 2), ("b", at(4.0), at(4.0), 1)}


def test_sessions_hold_every_event(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/events.parquet").count()
    assert streams.stream_silence(spark, d).agg(F.sum("n")).first()[0] == n


def test_results_do_not_depend_on_the_split(spark, tmp_path, monkeypatch):
    hours = [0, 2400, 100, 2300, 1, 1200]  # files far from event order
    parts = [[(h + 0.1 * k, 1 + (i + k) % 3, ("purchase", "error", "signup", "error", "view")[(i + k) % 5], 200.0 * (k % 2)) for k in range(6)] for i, h in enumerate(hours)]
    # failures of user 9 on one day, before and after its success in other files
    for i in (0, 4):
        parts[i] += [(2 + i, 9, "error", 0.0)] * 3
    parts[2] += [(3, 9, "purchase", 200.0)]
    write_events(spark, tmp_path, parts)
    names = ("stream_ingest", "stream_quarantine", "stream_rate", "stream_silence")
    get = lambda: {n: sorted(map(tuple, streams.QUERIES[n](spark, str(tmp_path)).collect())) for n in names}
    whole = get()
    one = partial(streams.ingest.ingest_stream, files_per_batch=1)
    monkeypatch.setattr(streams.ingest, "ingest_stream", one)
    split = get()
    n = sum(map(len, parts))
    assert len(split["stream_ingest"]) == n and sum(r[2] for r in split["stream_rate"]) == n and sum(r[3] for r in split["stream_silence"]) == n
    assert 9 * 31 + 1 not in [r[0] for r in split["stream_quarantine"]]
    assert split == whole
