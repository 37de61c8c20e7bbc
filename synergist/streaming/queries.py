"""Streaming queries over the event table: each runs its stream to the end of the
available input and returns the stored result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import aggregates, oracles, refresh
from ..plans.aggregates import DUO_KEYS
from ..plans.queries import SCORE, rounded
from ..plans.views import FACTS, facts_of, whole_sides, whole_sides_of
from ..sources import tables
from ..sources.readers import scan_facts
from ..sources.scratch import checkpointed, fresh_path
from ..sources.sinks import append_new
from . import ingest

Query = Callable[[SparkSession, str], DataFrame]


def _work(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return fresh_path(spark, name)


def _events(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern, so that a single file is a source too
    rows = ingest.ingest_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, "parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events delivered twice arrive once; those stored before don't come again. The
    sink rules out both, so no event is too late."""
    work = _work(spark, "ingest")
    stored = spark.read.parquet(f"{d}/events.parquet").where("event_id % 10 = 0").withColumn("ts", F.col("ts").cast("timestamp"))
    tables.append(stored, f"{work}/table", [])
    rows = _events(spark, d)
    twice = rows.unionByName(_events(spark, d))
    ingest.run_available(twice, ingest.appending(f"{work}/table", ["event_id"]), f"{work}/state")
    return tables.read(spark, f"{work}/table").select("event_id", "user_id", "event_type", "value")


def stream_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Journal of users whose events fail ('error' counts as a failed attempt,
    'signup' as exclusion, a 'purchase' as success at any time)."""
    work = _work(spark, "journal")
    kind = F.when(F.col("event_type") == "error", "error_retryable").when(F.col("event_type") == "signup", "excluded").when((F.col("event_type") == "purchase") & (F.col("value") > 150), "ok")
    outcome = _events(spark, d).select((F.col("user_id") * 31 + F.dayofmonth("ts")).alias("event_id"), kind.alias("status")).where("status is not null")
    ingest.run_available(ingest.quarantined(outcome), ingest.journaling(f"{work}/journal"), f"{work}/state", "update")
    return ingest.latest_journal(spark, f"{work}/journal", 3)


def stream_rate(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type."""
    work = _work(spark, "rate")
    rates = ingest.ingest_rate(_events(spark, d), "ts", ["event_type"], None)
    schema = rates.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/table/batch={batch_id}")

    ingest.run_available(rates, write, f"{work}/state", "update")
    got = spark.read.schema(schema.add("batch", "long")).parquet(f"{work}/table")
    last = got.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_silence(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each event type split by two hours of silence; those that no
    silence has closed yet are among them."""
    work = _work(spark, "silence")
    stretches = ingest.activity(_events(spark, d), "ts", ["event_type"], "2 hours")
    schema = stretches.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/table/batch={batch_id}")

    ingest.run_available(stretches, write, f"{work}/state", "update")
    got = spark.read.schema(schema.add("batch", "long")).parquet(f"{work}/table")
    last = got.groupBy("stretch", "event_type").agg(*(F.max_by(c, "batch").alias(c) for c in ("start", "last_seen", "n")))
    rows = ingest.sessions(last, ["event_type"], "2 hours")
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n")


def stream_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Orders arrive as a stream; each batch rebuilds and replaces the aggregates of the
    periods that it touches. Returns the triples' counts as stored at the end."""
    root = _work(spark, "refresh")
    path = f"{d}/orders.parquet"
    orders = ingest.ingest_stream(spark, f"{path[:-1]}[{path[-1]}]", spark.read.parquet(path).schema, "parquet")
    arrived = orders.select(F.concat(F.lit("16."), (F.year("o_orderdate") - 1989).cast("string")).alias("period"))

    def rebuild(periods: list[str]) -> None:
        aggregates.refresh_from_sides(whole_sides(spark, d), periods, root, ("individual", "trio"))

    ingest.run_available(arrived, ingest.refreshing(rebuild), f"{root}/state")
    return tables.read(spark, f"{root}/trio").select("period", "segment", "jgl", "mid", "sup", "games", "wins")


def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Orders arrive in two deliveries, older ones first; each rebuilds the aggregates of
    the periods that it touches and then the scores of the window as it is by then.
    Returns the pair scores that readers see in the end."""
    root = _work(spark, "scores")
    period = F.concat(F.lit("16."), (F.year("o_orderdate") - 1989).cast("string"))
    orders = spark.read.parquet(f"{d}/orders.parquet").withColumn("period", period)
    stream = ingest.ingest_stream(spark, f"{root}/in/*", orders.schema, "parquet", WHOLE)

    def events_of(periods: list[str]) -> dict[str, DataFrame]:
        arrived = scan_facts(spark, f"{root}/orders", periods)
        return {"sides": whole_sides_of(arrived), **{x: facts_of(arrived, x) for x in "mpt"}}

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = append_new(batch, f"{root}/orders", ["o_orderkey"], "period", scoped=True)
        touched = sorted(r[0] for r in fresh.select("period").distinct().collect())  # a handful of labels
        if touched:
            refresh.refresh(root, touched, events_of, ("score_duo", "score_matchup"))

    for _ in _deliver(orders, f"{root}/in", F.year("o_orderdate") > 1999, [False, True]):
        ingest.run_available(stream, write, f"{root}/state")  # a delivery is one batch
    got = refresh.current(spark, root, "score_duo")
    return rounded(got.select("label", "segment", *DUO_KEYS, *SCORE), 9)


def _deliver(rows: DataFrame, path: str, part: Column, values: list) -> Iterator[int]:
    """Write ``rows`` in parts, one after the other; the number of each is given once it is
    written, so that a run of the stream takes this part and no later one."""
    for k, v in enumerate(values):
        rows.where(part.eqNullSafe(F.lit(v))).write.parquet(f"{path}/{k:03d}")
        yield k


#: Days of a part of the event log as ``stream_dedup`` gets it, and parts after which an
#: event is delivered once more, in time and too late.
PART_DAYS, SOON, LATE = 5, 1, 5
#: Files of a batch where a delivery is to be one batch.
WHOLE = 1_000_000


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The event log in parts of five days; every event comes again with the next part,
    which keyed state recognises, and with the fifth after, later than the watermark of
    ten days. Returns each event's day as stored, and the two counts of what was left out."""
    work = _work(spark, "dedup")
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    first = events.agg(F.date_trunc("day", F.min("ts")).alias("_first"))
    events = events.join(F.broadcast(first)).withColumn("part", F.floor(F.date_diff("ts", "_first") / PART_DAYS)).drop("_first")  # one row
    events = checkpointed(events)
    last = events.agg(F.max("part")).first()[0]
    schema = events.drop("part").schema
    stream = ingest.ingest_stream(spark, f"{work}/in/*", schema, "parquet", WHOLE)
    once = ingest.dedup_stream(stream, ["event_id"], "ts", f"{2 * PART_DAYS} days")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/table/batch={batch_id}")

    left_out = {"repeated": 0, "late": 0}
    for k in range(0 if last is None else last + 1):
        again = F.col("part").isin(k, k - SOON, k - LATE)
        events.where(again).drop("part").orderBy(F.xxhash64("event_id", F.lit(k))).write.parquet(f"{work}/in/{k:03d}")
        # a part is one batch, however many files it has
        counts = ingest.dropped(ingest.run_available(once, write, f"{work}/state"))
        left_out = {c: n + counts[c] for c, n in left_out.items()}
    got = spark.read.schema(schema).parquet(f"{work}/table").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))
    return got.select("*", F.lit(left_out["repeated"]).cast("long").alias("repeated"), F.lit(left_out["late"]).cast("long").alias("late"))


def stream_retention(spark: SparkSession, d: str) -> DataFrame:
    """The event log arrives in six parts that don't follow its order; rows older than 24
    hours leave. Kept and gone rows by type."""
    work = _work(spark, "retention")
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    stream = ingest.ingest_stream(spark, f"{work}/in/*", events.schema, "parquet", WHOLE)
    expire = ingest.expiring(f"{work}/table", "ts", ["event_id"], 24, ["event_type"])
    part = F.pmod(F.dayofmonth("ts") * 7, F.lit(6))
    for _ in _deliver(events, f"{work}/in", part, list(range(6))):
        ingest.run_available(stream, expire, f"{work}/state")  # a part is one batch, however many files it has
    gone = spark.read.schema("event_type string, n long").parquet(f"{work}/table-gone").groupBy("event_type").agg(F.sum("n").alias("gone"))
    kept = tables.read(spark, f"{work}/table").groupBy("event_type").agg(F.count("*").alias("kept"), F.max("event_id").alias("last_id"))
    both = gone.join(kept, "event_type", "full_outer")
    return both.select("event_type", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), "last_id", F.coalesce("gone", F.lit(0).cast("long")).alias("gone"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (stream_ingest, stream_quarantine, stream_rate, stream_silence, stream_refresh, stream_scores, stream_dedup, stream_retention)}

ORACLE: dict[str, str] = {
    "stream_scores": oracles.ORACLE["duo_scores"],
    "stream_dedup": """
with e as (
  select event_id, ts, event_type, date_diff('day', (select min(ts) from events), ts) // 5 as part from events),
c as (
  select (count(*) filter (where part + 1 <= top))::bigint as repeated, (count(*) filter (where part + 5 <= top))::bigint as late
  from e, (select max(part) as top from e))
select strftime(ts, '%Y-%m-%d') as day, event_type, count(*)::bigint as n, count(distinct event_id)::bigint as n_ids, any_value(repeated) as repeated, any_value(late) as late
from e, c group by 1, 2
""",
    "stream_retention": """
with e as (
  select event_id, event_type, ts > (select max(ts) from events) - interval 24 hour as fresh from events)
select event_type, (count(*) filter (where fresh))::bigint as kept, max(event_id) filter (where fresh) as last_id, (count(*) filter (where not fresh))::bigint as gone
from e group by event_type
""",
    "stream_refresh": f"with {FACTS} select period, segment, jgl, mid, sup, count(*)::bigint as games, (count(*) filter (where win))::bigint as wins from t group by all",
    "stream_ingest": "select event_id, user_id, event_type, value from events",
    "stream_quarantine": """
with o as (
  select user_id * 31 + day(ts) as event_id, case when event_type = 'error' then 2 when event_type = 'signup' then 1 when event_type = 'purchase' and value > 150 then 0 end as rank from events),
g as (
  select event_id, min(rank) as best, (count(*) filter (where rank = 2))::bigint as attempts from o where rank is not null group by 1)
select event_id, case when best = 1 then 'excluded' when attempts >= 3 then 'error_permanent' else 'error_retryable' end as status, attempts from g where best > 0
""",
    "stream_silence": """
with s as (
  select event_type, ts, coalesce(ts - lag(ts) over g >= interval 2 hour, true)::int as fresh from events window g as (partition by event_type order by ts)),
k as (
  select event_type, ts, sum(fresh) over (partition by event_type order by ts rows unbounded preceding) as session from s)
select event_type, min(ts) as start, max(ts) as last_seen, count(*)::bigint as n from k group by event_type, session
""",
    "stream_rate": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*)::bigint as n from events group by all",
}
