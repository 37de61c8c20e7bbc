"""Structured Streaming ingest: exactly-once documents, quarantine, incremental
aggregates, retention and rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import tables
from ..sources.scratch import checkpointed
from ..sources.sinks import append_new


def ingest_stream(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """Stream of new files under ``path``."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def dedup_stream(df: DataFrame, keys: list[str], ts: str, delay: str = "24 hours") -> DataFrame:
    """Each key once across overlapping deliveries within ``delay``; state older
    than the watermark is dropped, and so are rows later than it (``dropped`` counts
    them)."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available, then stop (a service uses processingTime)."""
    query = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def appending(path: str, keys: list[str], partition: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch function: append rows whose key isn't stored. Replays add nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_new(batch, path, keys, partition)

    return write


def merge_quarantine(journal: DataFrame | None, outcome: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Journal (event_id, status, attempts) after a batch of outcomes (event_id,
    status in 'ok', 'excluded', 'error_retryable').

    'excluded' is terminal; errors count attempts and turn 'error_permanent' at
    ``max_attempts``; success removes the entry. Terminal entries never change, so
    the result depends on the order of the batches (``quarantining``'s doesn't).
    """
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "excluded", 1).otherwise(2)
    now = outcome.groupBy("event_id").agg(F.min_by("status", rank).alias("now"), F.count_if(F.col("status") == "error_retryable").alias("errors"))
    if journal is None:
        journal = outcome.select("event_id", "status", F.lit(0).cast("long").alias("attempts")).limit(0)
    rows = journal.join(now, "event_id", "full_outer")
    terminal = F.coalesce(F.col("status").isin("excluded", "error_permanent"), F.lit(False))
    tried = F.coalesce("attempts", F.lit(0).cast("long")) + F.coalesce("errors", F.lit(0).cast("long"))
    status = (
        F.when(terminal | F.col("now").isNull(), F.col("status"))
        .when(F.col("now") == "ok", F.lit(None).cast("string"))
        .when(F.col("now") == "excluded", "excluded")
        .when(tried >= max_attempts, "error_permanent")
        .otherwise("error_retryable")
    )
    attempts = F.when(terminal | F.col("now").isNull(), F.col("attempts")).otherwise(tried)
    return rows.select("event_id", status.alias("status"), attempts.alias("attempts")).where("status is not null")


def tally(outcome: DataFrame) -> DataFrame:
    """Outcomes (event_id, status) counted by event: oks, exclusions, attempts."""
    count = lambda s: F.count_if(F.col("status") == s)
    return outcome.groupBy("event_id").agg(count("ok").alias("oks"), count("excluded").alias("exclusions"), count("error_retryable").alias("attempts"))


def quarantined(outcome: DataFrame) -> DataFrame:
    """Stream of the tallies that a batch changes (update mode). The state keeps three
    counters for each event, so a batch costs what it brings, not what came before."""
    return tally(outcome)


def journaling(path: str) -> Callable[[DataFrame, int], None]:
    """Batch function: write the changed tallies of a batch. A replay of a batch writes
    the same rows again in the same place."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_journal(spark: SparkSession, path: str, max_attempts: int = 3) -> DataFrame:
    """(event_id, status, attempts) from the newest tally of each event. One that
    succeeded at any time has no status, 'excluded' comes before errors; sums don't
    depend on how the outcomes are split in batches or ordered."""
    status = F.when(F.col("exclusions") > 0, "excluded").when(F.col("attempts") >= max_attempts, "error_permanent").otherwise("error_retryable")
    counts = ("oks", "exclusions", "attempts")
    last = spark.read.parquet(path).groupBy("event_id").agg(F.max_by(F.struct(*counts), "batch").alias("_t")).select("event_id", "_t.*")
    return last.where("oks = 0").select("event_id", status.alias("status"), "attempts")


def refreshing(rebuild: Callable[[list[str]], None], period: str = "period") -> Callable[[DataFrame, int], None]:
    """Batch function: rebuild only the periods that a batch touches (a handful of
    distinct labels)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        touched = [r[0] for r in batch.select(period).where(F.col(period).isNotNull()).distinct().collect()]
        if touched:
            rebuild(sorted(touched))

    return write


def ingest_rate(df: DataFrame, ts: str = "ts", by: list[str] | None = None, delay: str | None = "24 hours", width: str = "1 day") -> DataFrame:
    """Tumbling counts. Rows later than ``delay`` aren't counted; without a delay (a
    bounded replay) every row is."""
    rows = (df.withWatermark(ts, delay) if delay else df).groupBy(F.window(ts, width), *(by or [])).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), *(by or []), "n")


def activity(df: DataFrame, ts: str = "ts", by: list[str] | None = None, gap: str = "3 minutes") -> DataFrame:
    """Rows, first and last time of each stretch of ``gap`` (update mode). Two rows of a
    stretch are less than ``gap`` apart, so ``sessions`` finds all sessions from these."""
    rows = df.groupBy(F.window(ts, gap), *(by or [])).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("last_seen"))
    return rows.select(F.col("window.start").alias("stretch"), "start", "last_seen", *(by or []), "n")


def sessions(stretches: DataFrame, by: list[str], gap: str = "3 minutes") -> DataFrame:
    """All sessions of ``activity``'s stretches, the open ones too. The windows see a
    row for each stretch only."""
    order = Window.partitionBy(*by).orderBy("start")
    fresh = F.col("start") >= F.lag("last_seen").over(order) + F.expr(f"interval {gap}")
    rows = stretches.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    rows = rows.withColumn("_session", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*by, "_session").agg(F.min("start").alias("start"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n")).select("start", "last_seen", *by, "n")


def expiring(path: str, ts: str, keys: list[str], hours: int = 24, by: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Batch function: keep the rows of the last ``hours`` of event time in a stored
    table partitioned by day, and count what goes in ``<path>-gone`` by ``by``.

    Days that are over go by the manifest alone, and only the day of the horizon is
    written anew; rows that arrive too late go at once. What stays in the end, and
    how much went, don't depend on the split in batches.
    """
    by = by or []
    day = F.date_format(ts, "yyyy-MM-dd").alias("_day")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = checkpointed(batch.select("*", day))
        stored = tables.read(spark, path)
        newest = rows.agg(F.max(ts)).union(stored.agg(F.max(ts))) if stored is not None else rows.agg(F.max(ts))
        top = newest.agg(F.max(newest.columns[0]).alias("top")).select((F.col("top") - F.make_interval(hours=F.lit(hours))).alias("at")).first()[0]
        if top is None:
            return
        horizon = F.lit(top)
        gone = rows.where(F.col(ts) <= horizon).select(*by)
        if stored is not None:
            gone = gone.unionByName(stored.where(F.col(ts) <= horizon).select(*by))
        checkpointed(gone.groupBy(*by).agg(F.count("*").alias("n"))).write.mode("overwrite").parquet(f"{path}-gone/batch={batch_id}")
        append_new(rows.where(F.col(ts) > horizon), path, keys, "_day", scoped=True)
        days = [r[0] for r in tables.entries(spark, path).select("_day").distinct().collect()]  # a value for each day
        edge = top.strftime("%Y-%m-%d")
        tables.drop(spark, path, [x for x in days if x < edge])
        if edge in days:
            at_edge = tables.read(spark, path, [edge])
            if at_edge.where(F.col(ts) <= horizon).take(1):
                tables.replace(checkpointed(at_edge.where(F.col(ts) > horizon)), path, ["_day"], [edge])

    return write


def dropped(query: StreamingQuery) -> dict[str, int]:
    """Rows that a stateful query left out: later than its watermark, and repeats of a
    key it knew. Taken from the progress reports that the query keeps."""
    late = repeated = 0
    for report in query.recentProgress:
        for op in report["stateOperators"]:
            late += op.get("numRowsDroppedByWatermark", 0)
            repeated += (op.get("customMetrics") or {}).get("numDroppedDuplicateRows", 0)
    return {"late": late, "repeated": repeated}
